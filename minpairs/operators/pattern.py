"""Dependency-graph patterns compiled to joins.

A pattern is given as a small Python spec, not as text:

    Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}},
            edges=[("V", "nsubj", "N")],
            without=[Pattern(nodes={"X": {}}, edges=[("N", "obj", "X")])])

* node constraints: ``form lemma upos xpos`` are columns, any other key is
  a morphological feature (``feats[lower(key)]``); a value is a string
  (equality), a list (any of) or None (feature absent);
* an edge ``(head, label, dependent)`` holds when the dependent's head is
  the head node and its ``deprel`` equals the label exactly (``nsubj``
  does not match ``nsubj:pass``); label None means any relation;
* distinct node names bind distinct tokens;
* ``without`` clauses are negative conditions: names shared with the
  pattern are bound, new names are existential.

Plan: a sentence's tokens are in one row, so a pattern is one expression
over that row (``match_in_row``): the head of a bound token is found by
position, its dependents by ``exists``, and a ``without`` clause is a
negated ``exists``.  Matching shuffles nothing.  ``match`` does the same on
a token table alone, with equi joins on ``(sent_ord, tid) = (sent_ord,
head)`` and ``left_anti`` joins.
Patterns must be connected: unrelated nodes would bind every pair of
tokens within a sentence.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.treebank import words_of

_COLUMNS = ("form", "lemma", "upos", "xpos", "deprel")


@dataclass(frozen=True)
class Pattern:
    nodes: dict = field(default_factory=dict)
    edges: list = field(default_factory=list)
    without: list = field(default_factory=list)

    def all_names(self) -> set:
        names = set(self.nodes)
        for h, _, d in self.edges:
            names.update((h, d))
        return names

    def fields(self) -> tuple[str, ...]:
        """The token fields that matching reads in the sentence row."""
        asked = {k if k in _COLUMNS else "feats" for p in (self, *self.without) for n in p.nodes.values() for k in n or {}}
        return tuple(sorted(asked | {"tid", "head", "deprel"}))


def _value_cond(c: Column, v) -> Column:
    if v is None:
        return c.isNull()
    if isinstance(v, (list, tuple, set, frozenset)):
        return c.isin(list(v))
    return c == F.lit(v)


def node_condition(constraints: dict, get) -> Column:
    """Conjunction of attribute tests; ``get(name)`` returns the Column
    for a token attribute (a table column or a struct field)."""
    conds = []
    for k, v in (constraints or {}).items():
        c = get(k) if k in _COLUMNS else get("feats")[k.lower()]
        conds.append(_value_cond(c, v))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _label_cond(c: Column, label) -> Column:
    return F.lit(True) if label is None else _value_cond(c, label)


def _check_connected(names: set, edges: list, start: set) -> None:
    seen = set(start)
    changed = True
    while changed:
        changed = False
        for h, _, d in edges:
            if (h in seen) != (d in seen):
                seen.update((h, d))
                changed = True
    missing = names - seen
    if missing:
        raise ValueError(f"pattern nodes {sorted(missing)} are not connected to the rest by an edge")


def _unknown(name: str, names: set) -> str:
    return f"target {name!r} is not a node of the pattern (nodes: {', '.join(sorted(names))})"


def _frame(tokens: DataFrame, name: str, constraints: dict, key: str = "_sid") -> DataFrame:
    # fresh aliases for every column: frames of one token table are joined
    # with each other, so no attribute may be shared between the sides
    cond = node_condition(constraints, F.col) & F.col("tid").isNotNull()
    return tokens.where(cond).select(
        F.col("sent_ord").alias(key), *([F.col("sid").alias("_name")] if key == "sid" else []),
        F.col("tid").alias(f"{name}__tid"),
        F.col("head").alias(f"{name}__head"),
        F.col("deprel").alias(f"{name}__deprel"),
    )


def _bind(tokens: DataFrame, bound: DataFrame, bound_names: list, nodes: dict, edges: list,
          exclude_from: list | None = None) -> tuple[DataFrame, list]:
    """Extend ``bound`` along ``edges`` until every node is bound.

    Each edge is one equi join (new node) or one filter (both bound); the
    label test references one side only, so Catalyst pushes it below the
    join into that side's scan."""
    bound_names = list(bound_names)
    pending = list(edges)
    while pending:
        progressed = False
        for e in list(pending):
            h, lab, d = e
            hb, db = h in bound_names, d in bound_names
            if not (hb or db):
                continue
            if hb and not db:
                fr = _frame(tokens, d, nodes.get(d, {}))
                bound = bound.join(fr, (F.col("sid") == F.col("_sid")) & (F.col(f"{d}__head") == F.col(f"{h}__tid")),
                                   "inner").drop("_sid")
                bound_names.append(d)
            elif db and not hb:
                fr = _frame(tokens, h, nodes.get(h, {}))
                bound = bound.join(fr, (F.col("sid") == F.col("_sid")) & (F.col(f"{h}__tid") == F.col(f"{d}__head")),
                                   "inner").drop("_sid")
                bound_names.append(h)
            else:
                bound = bound.where(F.col(f"{d}__head") == F.col(f"{h}__tid"))
            bound = bound.where(_label_cond(F.col(f"{d}__deprel"), lab))
            pending.remove(e)
            progressed = True
        if not progressed:
            raise ValueError("pattern is not connected")
    # distinct names bind distinct tokens
    others = exclude_from or []
    new = [n for n in bound_names if n not in others]
    conds = []
    for i, a in enumerate(new):
        for b in new[i + 1:] + [o for o in others if o not in new]:
            conds.append(F.col(f"{a}__tid") != F.col(f"{b}__tid"))
    if conds:
        bound = bound.where(reduce(lambda x, y: x & y, conds))
    return bound, bound_names


def bindings(tokens: DataFrame, pattern: Pattern, start: str) -> tuple[DataFrame, list]:
    """All bindings of the positive part of ``pattern`` (one column group
    ``<name>__tid/__head/__deprel`` per node)."""
    names = pattern.all_names()
    if start not in names:
        raise KeyError(_unknown(start, names))
    _check_connected(names, pattern.edges, {start})
    root = _frame(tokens, start, pattern.nodes.get(start, {}), key="sid")
    return _bind(tokens, root, [start], pattern.nodes, pattern.edges)


def _apply_without(tokens: DataFrame, bound: DataFrame, names: list, w: Pattern) -> DataFrame:
    shared = [n for n in w.all_names() if n in names]
    if not shared:
        raise ValueError("a without clause must mention at least one node of the pattern")
    _check_connected(w.all_names(), w.edges, set(shared))
    key_cols = ["sid"] + [f"{n}__tid" for n in names]
    ext = bound.select(*key_cols, *[f"{n}__head" for n in names], *[f"{n}__deprel" for n in names])
    # extra constraints on shared nodes: semi join on the bound id
    for n in shared:
        cons = w.nodes.get(n)
        if cons:
            fr = tokens.where(node_condition(cons, F.col)).select(
                F.col("sent_ord").alias("_s"), F.col("tid").alias("_t"))
            ext = ext.join(fr, (F.col("sid") == F.col("_s")) & (F.col(f"{n}__tid") == F.col("_t")), "left_semi")
    new_nodes = {n: c for n, c in w.nodes.items() if n not in names}
    ext, _ = _bind(tokens, ext, list(names), new_nodes, w.edges, exclude_from=list(names))
    hits = ext.select(*key_cols).distinct()
    return bound.join(hits, key_cols, "left_anti")


def match(tokens: DataFrame, pattern: Pattern, target: str, keep: str = "all") -> DataFrame:
    """Target token ids of every match.

    keep='all' -> distinct (sentence, target) pairs (C8);
    keep='last' -> one target per sentence, the last in token order (C7,
    the reference's behaviour); keep='first' -> the first."""
    if keep not in ("all", "last", "first"):
        raise ValueError("keep must be 'all', 'last' or 'first'")
    bound, names = bindings(tokens, pattern, target)
    for w in pattern.without:
        bound = _apply_without(tokens, bound, names, w)
    m = bound.select(F.col("sid").alias("sent_ord"), F.col("_name").alias("sentence_id"), F.col(f"{target}__tid").alias("match_id"))
    if keep == "all":
        # one node: (sentence, token) is already unique, no shuffle needed
        return m if len(names) == 1 else m.distinct()
    agg = F.max if keep == "last" else F.min
    return m.groupBy("sent_ord").agg(F.first("sentence_id").alias("sentence_id"), agg("match_id").alias("match_id"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _extend(words: Column, bound: dict, nodes: dict, edges: list, then) -> Column:
    """True if the edges can be bound one after another, each to a new token,
    and ``then(bound)`` holds."""
    def label(e, dependent) -> Column:
        return _label_cond(dependent["deprel"], e[1])

    for e in edges:
        h, _, d = e
        rest = [x for x in edges if x is not e]
        if h in bound and d in bound:
            return (bound[d]["head"] == bound[h]["tid"]) & label(e, bound[d]) & _extend(words, bound, nodes, rest, then)
        if h not in bound and d not in bound:
            continue
        new = d if h in bound else h

        def fits(x):  # used before the loop goes on
            cond = node_condition(nodes.get(new, {}), lambda k: x[k])
            if h in bound:
                cond = (x["head"] == bound[e[0]]["tid"]) & label(e, x) & cond
            for other in bound.values():
                cond = cond & (x["tid"] != other["tid"])
            return _sure(cond & _extend(words, {**bound, new: x}, nodes, rest, then))

        if h in bound:
            return F.exists(words, fits)
        # the head stands at its own position, unless ids have gaps
        at = bound[d]["head"]
        there = F.when((at >= 1) & _sure(F.get(words, at - 1)["tid"] == at), F.slice(words, F.greatest(at, F.lit(1)), 1)).otherwise(
            F.filter(words, lambda w: w["tid"] == at))
        return label(e, bound[d]) & F.exists(there, fits)
    return then(bound)


def target_ids_in_row(pattern: Pattern, target: str, keep: str = "all", tokens_col: str = "tokens") -> Column:
    """C1-C8 inside the sentence row: the array of target ids (no join, no shuffle)."""
    if keep not in ("all", "last", "first"):
        raise ValueError("keep must be 'all', 'last' or 'first'")
    names = pattern.all_names()
    if target not in names:
        raise KeyError(_unknown(target, names))
    _check_connected(names, pattern.edges, {target})
    for w in pattern.without:
        shared = w.all_names() & names
        if not shared:
            raise ValueError("a without clause must mention at least one node of the pattern")
        _check_connected(w.all_names(), w.edges, shared)

    def clauses(words, bound) -> Column:
        ok = F.lit(True)
        for w in pattern.without:
            cond = F.lit(True)
            for n in w.all_names() & names:
                cond = cond & node_condition(w.nodes.get(n, {}), lambda k, n=n: bound[n][k])
            ok = ok & ~_sure(cond & _extend(words, bound, w.nodes, list(w.edges), lambda b: F.lit(True)))
        return ok

    def ids(words) -> Column:
        def fits(t):
            return _sure(node_condition(pattern.nodes.get(target, {}), lambda k: t[k])
                         & _extend(words, {target: t}, pattern.nodes, list(pattern.edges), lambda b: clauses(words, b)))
        return F.array_distinct(F.transform(F.filter(words, fits), lambda t: t["tid"]))

    found = let(words_of(tokens_col), ids)
    if keep == "all":
        return found
    pick = F.array_max if keep == "last" else F.array_min
    return let(found, lambda x: F.when(F.size(x) > 0, F.array(pick(x))).otherwise(F.slice(x, 1, 0)))


def match_in_row(sentences: DataFrame, pattern: Pattern, target: str, keep: str = "all") -> DataFrame:
    """Same result as ``match``, computed in-row."""
    return sentences.select(
        "sent_ord", F.col("sid").alias("sentence_id"),
        F.explode_outer(target_ids_in_row(pattern, target, keep)).alias("match_id"),
    ).where(F.col("match_id").isNotNull())
