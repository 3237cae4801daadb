import re

from minpairs.llm import lines


def units_of(text):
    """(line, unit): lines cut after their sentence ends."""
    return [(i, u) for i, x in enumerate(text.split("\n")) for u in re.sub("([.!?][\"')\\]]*[ \t]+)([^ \t\r\x0b\x0c])", "\\1\n\\2", x).split("\n")]


def brute(rows):
    """Rows by (doc, window); the first occurrence of a window stays, later ones lose what it does not cover itself."""
    docs, worded = {}, {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            docs[i] = units_of(t)
            worded[i] = [p for p, (_, u) in enumerate(docs[i]) if u.strip(" \t\r\x0b\x0c")]
    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        w = [docs[i][p][1].strip(" \t\r") for p in worded[i]]
        for k in range(max(len(w) - 2, min(1, len(w)))):
            key = tuple(w[k:k + 3])
            f = first.setdefault(key, (i, k))
            if f != (i, k):
                gone[i] |= set(range(max(k, f[1] + 3) if f[0] == i else k, min(k + 3, len(w))))
    out = []
    for i, t, *_ in rows:
        if i not in docs:
            out.append((i, 0, 0, t))
            continue
        drop, kept = {worded[i][j] for j in gone[i]}, {}
        for p, (line, u) in enumerate(docs[i]):
            if p not in drop:
                kept[line] = kept.get(line, "") + u
        out.append((i, len({docs[i][p][0] for p in worded[i]}), len(gone[i]), "\n".join(kept[k] for k in sorted(kept))))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_removed", "text").collect()], key=str)


def test_windows(docs_of):
    lic = "copyright line\nall rights\nno warranty"
    rows = [(1, f"a\n{lic}\nb"), (2, f"{lic}\nc\n\nd"), (3, f"x\n\n{lic}\ncopyright line\nall rights"), (4, "r\n" * 9), (5, "r\nr\nr\ns"),
            (6, "a\nb"), (7, ""), (8, None), (9, " \n\n"), (10, "p\nq\nr\ns\nt\nu\nv"), (11, "q\nr\ns\nt\nu"), (12, "É\né\r\nz\nÉ\né\r\nz\nÉ")]
    assert result(lines.line_dedup(docs_of(rows, extra=True))) == brute(rows)


def test_repeated_rows_and_ids(docs_of):
    text = "one\ntwo\nthree\nfour"
    assert result(lines.line_dedup(docs_of([(1, text), (1, text), (2, text), (None, text)]))) == [
        (1, 4, 0, text), (1, 4, 0, text), (2, 4, 4, ""), (None, 4, 4, "")]


def test_hot_window_and_empty(docs_of):
    rows = [(k, f"u{k}\nhot a\nhot b\nhot c\nv{k}" if k % 3 else f"only {k}") for k in range(200)]
    assert result(lines.line_dedup(docs_of(rows))) == brute(rows)
    assert lines.line_dedup(docs_of([])).collect() == []


def test_long_text(docs_of):
    text = "\n".join(f"line {k % 4000}" for k in range(9000))
    rows = [(1, text), (2, "\n".join(f"line {k}" for k in range(100)))]
    assert result(lines.line_dedup(docs_of(rows))) == brute(rows)


def test_rows_without_an_id_and_ids_with_several_texts(docs_of):
    rows = [(1, "a\nb\nc"), (None, "a\nb\nc"), (None, "e\nf\ng"), (None, "h\ni\nj"), (None, "h\ni\nj"),
            (5, "p\nq\nr"), (5, "s\nt\nu"), (6, "p\nq\nr\nv"), (5, "a\nb\nc\nw")]
    got = result(lines.line_dedup(docs_of(rows)))
    assert got == sorted([(1, 3, 0, "a\nb\nc"), (None, 3, 3, ""), (None, 3, 0, "e\nf\ng"), (None, 3, 0, "h\ni\nj"), (None, 3, 3, ""),
                          (5, 3, 0, "p\nq\nr"), (5, 3, 0, "s\nt\nu"), (6, 4, 3, "v"), (5, 4, 3, "w")], key=str)


def test_passages_inside_long_lines(docs_of):
    """A line is cut at its sentence ends: three equal sentences are found wherever they stand."""
    shared = "First things come first. Second thoughts are best! Is a third one needed? Nobody knows."
    rows = [(1, f"One opens. {shared} One ends.\nother line"), (2, f"Two opens here.\n{shared}\nTwo ends."), (3, f"Three says: {shared}"),
            (4, "First things come first. Second thoughts are best!"), (5, "e.g. this v1.5 is one.  Two (here.) Three \"so.\" Four"), (6, "x. \n y.\t\r\nz. \x0b"),
            (7, "First things come first."), (8, "First things come first. Second thoughts are best!"), (9, "First things come first.\n\n"), (10, ". . . a")]
    got = result(lines.line_dedup(docs_of(rows, extra=True)))
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by[2][3] == "Two opens here.\nTwo ends." and by[3][3] == "Three says: First things come first. " and by[8][3] == "" and by[9][3] == "\n"
    assert by[4][2] == by[7][2] == 0


def test_hot_passage_and_very_long_text(docs_of):
    rows = [(k, f"Own start {k}. Very common one. Very common two. Very common three. Own end {k}.") for k in range(300)]
    rows.append((999, " ".join(f"Sentence {k % 20000} of a long text." for k in range(60_000))))  # one line of 1.7 MB
    assert result(lines.line_dedup(docs_of(rows))) == brute(rows)
