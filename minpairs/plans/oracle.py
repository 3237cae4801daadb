"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: the derived treebank is
restated from its definition (``sources.derived``), patterns are plain
joins / NOT EXISTS, and surface alignment uses the position formula
(pieces are joined by single spaces) rather than a search.
"""

from __future__ import annotations

# The derived treebank (words ``d_tok``, range rows ``d_rng``, sentences ``d_sent``).
DERIVED = r"""
d_lines AS (
  SELECT doc_id, lang, source, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS ln
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)
),
d_sent AS MATERIALIZED (
  SELECT 'd' || CAST(doc_id AS VARCHAR) || '-s' || CAST(ln AS VARCHAR) AS sid,
         doc_id, ln, lang, source, line AS text,
         list_filter(string_split(line, ' '), lambda x: x <> '') AS forms,
         (doc_id + ln) % 3 = 0 AND len(list_filter(string_split(line, ' '), lambda x: x <> '')) >= 3 AS ranged
  FROM d_lines
),
d_w AS (
  SELECT sid, doc_id, ln, ranged, unnest(forms) AS form, generate_subscripts(forms, 1) AS tid FROM d_sent
),
d_tok0 AS (
  SELECT sid, doc_id, ln, ranged, tid, form,
         CASE WHEN ranged AND tid >= 2 THEN tid ELSE tid - 1 END AS pos,
         lower(substr(form, 1, 4)) AS lemma,
         CASE length(form) % 3 WHEN 0 THEN 'VERB' WHEN 1 THEN 'NOUN' ELSE 'ADJ' END AS upos,
         CASE WHEN length(form) % 2 = 0 THEN 'Sing' ELSE 'Plur' END AS num,
         tid - 1 AS head
  FROM d_w
),
d_tok AS MATERIALIZED (
  SELECT *,
         CASE WHEN upos = 'NOUN' THEN (CASE WHEN tid % 2 = 0 THEN 'Nom' ELSE 'Acc' END) END AS cas,
         CASE WHEN tid = 1 THEN 'root' WHEN upos = 'NOUN' AND tid % 2 = 0 THEN 'nsubj'
              WHEN upos = 'NOUN' THEN 'obj' ELSE 'dep' END AS deprel
  FROM d_tok0
),
d_rng AS (
  SELECT sid, doc_id, ln, 1 AS pos, '2-3' AS id, forms[2] || ' ' || forms[3] AS form FROM d_sent WHERE ranged
),
d_lex AS MATERIALIZED (
  SELECT sid AS sentence_id, tid - 1 AS token_id, form, lemma, upos, CAST(NULL AS VARCHAR) AS xpos,
         cas AS feats__case, num AS feats__number, doc_id, ln, tid
  FROM d_tok WHERE form NOT IN ('.', ',', '!', '?', '*')
)
"""

EDGE_MATCHES = """
edge_m AS MATERIALIZED (
  SELECT n.sid, n.tid AS n_tid, v.tid AS v_tid
  FROM d_tok n JOIN d_tok v ON v.sid = n.sid AND v.tid = n.head
  WHERE n.upos = 'NOUN' AND v.upos = 'VERB' AND n.deprel = 'nsubj'
),
last_m AS (SELECT sid, max(n_tid) AS tid FROM edge_m GROUP BY sid),
tgt AS MATERIALIZED (
  SELECT s.sid, s.text, s.ranged, s.forms, t.tid, t.form, t.pos
  FROM last_m m JOIN d_sent s ON s.sid = m.sid JOIN d_tok t ON t.sid = m.sid AND t.tid = m.tid
),
-- surface alignment: pieces are separated by exactly one space
surf AS (
  SELECT *, coalesce(list_sum(list_transform(forms[1:tid - 1], lambda f: length(f))), 0) + (tid - 1) AS off0,
         ranged AND tid IN (2, 3) AS inside
  FROM tgt
)
"""


def w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


SQL = {}

SQL["tokens_scan"] = w(DERIVED) + """
SELECT sid AS sentence_id, pos, CAST(tid AS VARCHAR) AS id, tid, form, lemma, upos,
       num AS feats__number, cas AS feats__case, head, deprel FROM d_tok
UNION ALL
SELECT sid, pos, id, NULL, form, NULL, NULL, NULL, NULL, NULL, NULL FROM d_rng
"""

SQL["lexicon_filter"] = w(DERIVED) + """
SELECT sentence_id, token_id, form, lemma, upos, xpos, feats__case, feats__number FROM d_lex
"""

SQL["feature_names"] = w(DERIVED) + """
SELECT DISTINCT 'number' AS feature FROM d_lex WHERE feats__number IS NOT NULL
UNION SELECT DISTINCT 'case' FROM d_lex WHERE feats__case IS NOT NULL
"""

SQL["candidate_set"] = w(DERIVED) + """
SELECT sentence_id, token_id, form, lemma, upos, xpos, feats__case, feats__number FROM d_lex
WHERE feats__number = 'Plur'
"""

SQL["pattern_node"] = w(DERIVED) + """
SELECT sid AS sentence_id, tid AS match_id FROM d_tok WHERE upos = 'VERB' AND num = 'Sing'
"""

SQL["pattern_edge"] = w(DERIVED, EDGE_MATCHES) + """
SELECT DISTINCT sid AS sentence_id, n_tid AS match_id FROM edge_m
"""

SQL["pattern_chain3"] = w(DERIVED) + """
SELECT DISTINCT v.sid AS sentence_id, v.tid AS match_id
FROM d_tok v JOIN d_tok n ON n.sid = v.sid AND n.head = v.tid
             JOIN d_tok a ON a.sid = n.sid AND a.head = n.tid
WHERE v.upos = 'VERB' AND n.upos = 'NOUN' AND a.upos = 'ADJ' AND n.deprel = 'nsubj' AND a.deprel = 'dep'
  AND a.tid <> v.tid
"""

SQL["pattern_without"] = w(DERIVED, EDGE_MATCHES) + """
SELECT DISTINCT sid AS sentence_id, n_tid AS match_id FROM edge_m m
WHERE NOT EXISTS (SELECT 1 FROM d_tok x WHERE x.sid = m.sid AND x.head = m.n_tid AND x.deprel = 'obj'
                  AND x.tid <> m.n_tid AND x.tid <> m.v_tid)
"""

SQL["match_last"] = w(DERIVED, EDGE_MATCHES) + """
SELECT sid AS sentence_id, tid AS match_id FROM last_m
"""

SQL["match_all"] = w(DERIVED, EDGE_MATCHES) + """
SELECT DISTINCT sid AS sentence_id, v_tid AS match_id FROM edge_m
"""

SQL["masked_dataset"] = w(DERIVED, EDGE_MATCHES) + """
SELECT sid AS sentence_id, tid AS match_id, form AS match_token, text AS original_text,
       substr(text, 1, CAST(off0 AS BIGINT)) || '[MASK]' || substr(text, CAST(off0 + length(form) + 1 AS BIGINT)) AS masked_text
FROM surf WHERE NOT inside
"""

SQL["prompt_dataset"] = w(DERIVED, EDGE_MATCHES) + r"""
SELECT sid AS sentence_id, tid AS match_id, form AS match_token, text AS original_text,
       regexp_replace(substr(text, 1, CAST(off0 AS BIGINT)), '^\s+|\s+$', '', 'g') AS prompt_text
FROM surf WHERE NOT inside
"""

SQL["exception_dataset"] = w(DERIVED, EDGE_MATCHES) + """,
all_forms AS (
  SELECT sid, to_json(list(form ORDER BY pos)) AS all_tokens FROM (
    SELECT sid, pos, form FROM d_tok UNION ALL SELECT sid, pos, form FROM d_rng) GROUP BY sid
)
SELECT s.sid AS sentence_id, s.tid AS match_id, a.all_tokens, s.form AS match_token,
       s.text AS original_text, 'inside_range' AS reason
FROM surf s JOIN all_forms a ON a.sid = s.sid WHERE s.inside
"""

# legacy alignment: search each token line (ranges and their parts) in order
LEGACY = """,
seq AS (
  SELECT sid, list(form ORDER BY pos) AS toks FROM (
    SELECT sid, pos, form FROM d_tok UNION ALL SELECT sid, pos, form FROM d_rng) GROUP BY sid
),
walk AS (
  SELECT t.*, q.toks,
         list_reduce(q.toks[1:t.pos], lambda acc, f:
            CASE WHEN NOT acc.ok THEN acc
                 WHEN instr(substr(t.text, acc.off + 1), f) > 0
                   THEN {'off': acc.off + instr(substr(t.text, acc.off + 1), f) - 1 + length(f), 'ok': true}
                 WHEN f IN ('_', ' ') THEN acc
                 ELSE {'off': acc.off, 'ok': false} END,
            {'off': 0, 'ok': true}) AS st
  FROM tgt t JOIN seq q ON q.sid = t.sid
),
leg AS (
  SELECT *, CASE WHEN st.ok AND instr(substr(text, st.off + 1), form) > 0
                 THEN st.off + instr(substr(text, st.off + 1), form) - 1 END AS off0
  FROM walk
)
"""

SQL["masked_legacy"] = w(DERIVED, EDGE_MATCHES) + LEGACY + """
SELECT sid AS sentence_id, tid AS match_id, form AS match_token, text AS original_text,
       substr(text, 1, CAST(off0 AS BIGINT)) || '[MASK]' || substr(text, CAST(off0 + length(form) + 1 AS BIGINT)) AS masked_text
FROM leg WHERE off0 IS NOT NULL
"""

SQL["exception_legacy"] = w(DERIVED, EDGE_MATCHES) + LEGACY + """
SELECT sid AS sentence_id, tid AS match_id, to_json(toks) AS all_tokens, form AS match_token,
       text AS original_text, 'not_aligned' AS reason
FROM leg WHERE off0 IS NULL
"""

# --- minimal pairs -----------------------------------------------------------
# first-letter case as Python's str.isupper() on one character
UP = "(upper(substr({f}, 1, 1)) = substr({f}, 1, 1) AND lower(substr({f}, 1, 1)) <> substr({f}, 1, 1))"

PAIRS = """,
mk AS MATERIALIZED (SELECT sid, tid, form, text, off0 FROM surf WHERE NOT inside),
own AS (SELECT m.*, l.lemma, l.feats__case AS cas FROM mk m
        JOIN d_lex l ON l.sentence_id = m.sid AND l.token_id = m.tid - 1),
idx AS MATERIALIZED (
  SELECT lemma, feats__case AS cas, feats__number AS num, """ + UP.format(f="form") + """ AS up,
         first(form ORDER BY doc_id, ln, tid) AS alt
  FROM d_lex WHERE length(form) > 0 AND lemma IS NOT NULL GROUP BY ALL
),
mp AS MATERIALIZED (
  SELECT o.sid AS sentence_id, o.tid AS match_id, o.form AS form_grammatical, o.text AS original_text,
         substr(o.text, 1, CAST(o.off0 AS BIGINT)) || '[MASK]' || substr(o.text, CAST(o.off0 + length(o.form) + 1 AS BIGINT)) AS masked_text,
         i.alt AS form_ungrammatical
  FROM own o JOIN idx i ON i.lemma = o.lemma AND i.cas IS NOT DISTINCT FROM o.cas AND i.num = 'Plur'
       AND i.up = """ + UP.format(f="o.form") + """
  WHERE i.alt <> o.form
),
mps AS (SELECT sentence_id, match_id, ' ' || form_grammatical AS form_grammatical, original_text, masked_text,
               ' ' || form_ungrammatical AS form_ungrammatical FROM mp),
vocab AS MATERIALIZED (
  SELECT form_grammatical, form_ungrammatical,
         row_number() OVER (ORDER BY md5(form_grammatical || chr(1) || form_ungrammatical),
                            form_grammatical, form_ungrammatical) - 1 AS pair_pos
  FROM (SELECT DISTINCT form_grammatical, form_ungrammatical FROM mps)
)
"""

SQL["feature_override"] = w(DERIVED, EDGE_MATCHES) + """
SELECT m.sid AS sentence_id, m.tid AS match_id, 'Plur' AS alt_number, l.feats__case AS alt_case
FROM last_m m JOIN d_lex l ON l.sentence_id = m.sid AND l.token_id = m.tid - 1
"""

SQL["minimal_pairs"] = w(DERIVED, EDGE_MATCHES) + PAIRS + "SELECT * FROM mp"
SQL["minimal_pairs_spaced"] = w(DERIVED, EDGE_MATCHES) + PAIRS + "SELECT * FROM mps"
SQL["pair_vocabulary"] = w(DERIVED, EDGE_MATCHES) + PAIRS + "SELECT * FROM vocab"

# every row permutes 0..n-2 by rounds on a grid a x b; results beyond n - 2 are permuted again
PICKS = """,
n AS (SELECT n, n - 1 AS m, a, (n - 2 + a) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*) - 1))::BIGINT AS a FROM vocab)),
picks AS (
  WITH RECURSIVE walk(sentence_id, match_id, pair_pos, pick, s, l, r) AS (
    SELECT m.sentence_id, m.match_id, v.pair_pos, j, 0, j // n.b, j % n.b
    FROM mps m JOIN vocab v USING (form_grammatical, form_ungrammatical), n, range(0, 3) t(j)
    UNION ALL
    SELECT k.sentence_id, k.match_id, k.pair_pos, k.pick, k.s + 1,
           CASE WHEN k.s % 2 = 0 THEN (k.l + h.h) % n.a ELSE k.l END, CASE WHEN k.s % 2 = 1 THEN (k.r + h.h) % n.b ELSE k.r END
    FROM walk k, n, LATERAL (SELECT ('0x' || substr(md5(k.sentence_id || ':' || k.match_id::VARCHAR || ':7:' || (k.s % 4 + 1)::VARCHAR || ':'
                                                       || (CASE WHEN k.s % 2 = 0 THEN k.r ELSE k.l END)::VARCHAR), 1, 8))::BIGINT AS h) h
    WHERE NOT (k.s > 0 AND k.s % 4 = 0 AND k.l * n.b + k.r < n.m))
  SELECT sentence_id, match_id, pick, (pair_pos + 1 + l * n.b + r) % n.n AS p FROM walk, n WHERE s > 0 AND s % 4 = 0 AND l * n.b + r < n.m
)
"""
SQL["ood_pairs"] = w(DERIVED, EDGE_MATCHES) + PAIRS + PICKS + """
SELECT p.sentence_id, p.match_id, p.pick, v.form_grammatical AS ood_form_grammatical,
       v.form_ungrammatical AS ood_form_ungrammatical
FROM picks p JOIN vocab v ON v.pair_pos = p.p
"""

SQL["run_summary"] = w(DERIVED, EDGE_MATCHES) + PAIRS + """
SELECT (SELECT count(*) FROM surf) AS targets, (SELECT count(*) FROM mk) AS masked,
       (SELECT count(*) FROM surf WHERE inside) AS exceptions, (SELECT count(*) FROM mp) AS pairs
"""

SQL["mask_check"] = w(DERIVED, EDGE_MATCHES) + PAIRS + """
SELECT sid AS sentence_id, tid AS match_id,
       CAST((length(t) - length(replace(t, '[MASK]', ''))) / 6 AS INTEGER) AS n_masks,
       CASE WHEN (length(t) - length(replace(t, '[MASK]', ''))) / 6 = 0 THEN 'no_mask'
            WHEN (length(t) - length(replace(t, '[MASK]', ''))) / 6 > 1 THEN 'multiple_masks' ELSE 'ok' END AS status
FROM (SELECT sid, tid, substr(text, 1, CAST(off0 AS BIGINT)) || '[MASK]' || substr(text, CAST(off0 + length(form) + 1 AS BIGINT)) AS t FROM mk)
"""

SQL["truncate_display"] = w(DERIVED, EDGE_MATCHES) + PAIRS + """
SELECT sid AS sentence_id, tid AS match_id,
       CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS original_text_display,
       CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS masked_text_display
FROM (SELECT sid, tid, text, substr(text, 1, CAST(off0 AS BIGINT)) || '[MASK]' || substr(text, CAST(off0 + length(form) + 1 AS BIGINT)) AS t FROM mk)
"""

# Three tasks; the pair step differs per task (override, target pattern)
TASK_CTE = """,
node_last AS (SELECT sid, max(tid) AS tid FROM d_tok WHERE upos = 'VERB' AND num = 'Sing' GROUP BY sid),
node_tgt AS MATERIALIZED (
  SELECT s.sid, s.text, s.ranged, s.forms, t.tid, t.form,
         coalesce(list_sum(list_transform(s.forms[1:t.tid - 1], lambda f: length(f))), 0) + (t.tid - 1) AS off0,
         s.ranged AND t.tid IN (2, 3) AS inside
  FROM node_last m JOIN d_sent s ON s.sid = m.sid JOIN d_tok t ON t.sid = m.sid AND t.tid = m.tid
),
node_own AS (SELECT m.*, l.lemma, l.feats__case AS cas FROM node_tgt m
             JOIN d_lex l ON l.sentence_id = m.sid AND l.token_id = m.tid - 1 WHERE NOT m.inside),
node_mp AS (SELECT o.sid FROM node_own o JOIN idx i ON i.lemma = o.lemma AND i.cas IS NOT DISTINCT FROM o.cas
            AND i.num = 'Plur' AND i.up = """ + UP.format(f="o.form") + """ WHERE i.alt <> o.form),
own2 AS (SELECT m.*, l.lemma, l.feats__number AS num FROM mk m
         JOIN d_lex l ON l.sentence_id = m.sid AND l.token_id = m.tid - 1),
case_mp AS (SELECT o.sid FROM own2 o JOIN idx i ON i.lemma = o.lemma AND i.num IS NOT DISTINCT FROM o.num
            AND i.cas = 'Acc' AND i.up = """ + UP.format(f="o.form") + """ WHERE i.alt <> o.form)
"""

SQL["task_batch"] = w(DERIVED, EDGE_MATCHES) + PAIRS + TASK_CTE + """
SELECT 'nsubj_noun_number' AS task_name, (SELECT count(*) FROM mk) AS structures_masked,
       (SELECT count(*) FROM surf WHERE inside) AS exceptions, (SELECT count(*) FROM mp) AS minimal_pairs_found
UNION ALL
SELECT 'verb_sing_number', (SELECT count(*) FROM node_tgt WHERE NOT inside), (SELECT count(*) FROM node_tgt WHERE inside),
       (SELECT count(*) FROM node_mp)
UNION ALL
SELECT 'nsubj_noun_case', (SELECT count(*) FROM mk), (SELECT count(*) FROM surf WHERE inside), (SELECT count(*) FROM case_mp)
"""

# --- metrics ----------------------------------------------------------------------------
DBL = "CAST({} AS DOUBLE)"
I = "(CASE WHEN {p} > 0 AND NOT isnan({p}) THEN -log2({p}) ELSE CAST('inf' AS DOUBLE) END)"
R6 = "(round_even(({x}) * CAST(1000000 AS DOUBLE), 0) / CAST(1000000 AS DOUBLE))"
R2 = "(round_even(({x}) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE))"

LI = """li AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount AS p_g, l_tax AS p_u,
                 l_quantity / CAST(500 AS DOUBLE) AS p_u2, (l_discount + CAST(0.005 AS DOUBLE)) / CAST(1.01 AS DOUBLE) AS s_g,
                 (l_tax + CAST(0.005 AS DOUBLE)) / CAST(1.01 AS DOUBLE) AS s_u FROM lineitem)"""

SQL["surprisal"] = w(LI) + f"""
SELECT l_orderkey, l_linenumber, p_g, p_u, {R6.format(x=I.format(p='p_g'))} AS I_g, {R6.format(x=I.format(p='p_u'))} AS I_u FROM li
"""

SQL["avg_surprisal"] = w(LI) + f"""
SELECT {R2.format(x='avg(' + I.format(p='p_g') + ')')} AS avg_I_g, {R2.format(x='avg(' + I.format(p='p_u') + ')')} AS avg_I_u,
       {R2.format(x='avg(' + I.format(p='s_g') + ')')} AS avg_I_g_smooth, {R2.format(x='avg(' + I.format(p='s_u') + ')')} AS avg_I_u_smooth
FROM li
"""

POSAVG = w(LI) + f""", pos AS (SELECT {R2.format(x='avg(' + I.format(p='s_g') + ')')} AS g,
                                     {R2.format(x='avg(' + I.format(p='s_u') + ')')} AS u FROM li)"""
SQL["asd"] = POSAVG + f" SELECT {R2.format(x='u - g')} AS asd FROM pos"
SQL["norm_asd"] = POSAVG + " SELECT CASE WHEN g <> 0 THEN round_even((u - g) / g, 0) END AS norm_asd FROM pos"

SQL["predictions"] = w(LI) + """
SELECT l_orderkey, l_linenumber, CAST(coalesce(p_g > p_u, false) AS INTEGER) AS prediction FROM li
"""
SQL["accuracy"] = w(LI) + f"""
SELECT count(*) AS n, coalesce({R2.format(x='avg(CAST(coalesce(p_g > p_u, false) AS INTEGER))')}, 0.0) AS accuracy FROM li
"""
SQL["accuracy_multi"] = w(LI) + f"""
SELECT coalesce({R2.format(x='avg(CAST(coalesce(p_g > greatest(p_u, p_u2), false) AS INTEGER))')}, 0.0) AS accuracy FROM li
"""
SQL["classification_summary"] = w(LI) + f""",
c AS (SELECT count(*) AS n, sum(CAST(coalesce(p_g > p_u, false) AS INTEGER)) AS tp,
             {R2.format(x='avg(CAST(coalesce(p_g > p_u, false) AS INTEGER))')} AS acc FROM li)
SELECT n, tp, n - tp AS fn, CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS precision,
       {R6.format(x='tp / n')} AS recall,
       CASE WHEN tp > 0 THEN {R6.format(x='2.0::DOUBLE * 1.0 * (tp / n) / (1.0 + tp / n)')} ELSE 0.0::DOUBLE END AS f1,
       coalesce(acc, 0.0) AS accuracy
FROM c
"""

EMB = """
e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e1 AS (SELECT vec_id, label, x, list_transform(x, lambda v: exp(v - list_max(x))) AS ex FROM e0),
e2 AS (SELECT vec_id, label, len(x) AS n,
              list_transform(ex, lambda v: v / list_reduce(ex, lambda a, b: a + b)) AS probs FROM e1),
e3 AS (SELECT vec_id, label, n, list_filter(probs, lambda v: v > 0) AS p FROM e2),
e4 AS (SELECT vec_id, label, n, p, list_slice(list_reverse_sort(p), 1, 10) AS top FROM e3),
e5 AS (SELECT vec_id, label, n, p, list_transform(top, lambda v: v / list_reduce(top, lambda a, b: a + b)) AS pk FROM e4),
ent AS (
  SELECT vec_id, label, n,
         CASE WHEN len(p) = 0 THEN NULL WHEN len(p) = 1 THEN 0.0
              ELSE """ + R2.format(x="-list_reduce(list_transform(p, lambda v: v * ln(v)), lambda a, b: a + b)") + """ END AS h_all,
         CASE WHEN len(pk) = 0 THEN NULL WHEN len(p) = 1 THEN 0.0
              ELSE """ + R2.format(x="-list_reduce(list_transform(pk, lambda v: v * ln(v)), lambda a, b: a + b)") + """ END AS h_k10
  FROM e5
)
"""
SQL["entropy_topk"] = w(EMB) + "SELECT vec_id, h_all AS entropy_all, h_k10 AS entropy_k10 FROM ent"
SQL["certainty"] = w(EMB) + f"""
SELECT vec_id, {R2.format(x='1.0::DOUBLE - h_all / ln(n)')} AS certainty_all,
       {R2.format(x='1.0::DOUBLE - h_k10 / ln(n)')} AS certainty_k10 FROM ent
"""
SQL["avg_certainty"] = w(EMB) + f"""
SELECT label, {R2.format(x='avg(' + R2.format(x='1.0::DOUBLE - h_k10 / ln(n)') + ')')} AS avg_certainty FROM ent GROUP BY label
"""

# --- n-gram scoring --------------------------------------------------------------------
BIGRAM = """,
bg AS MATERIALIZED (SELECT sid, i + 1 AS tid, forms[i] AS prev, forms[i + 1] AS w FROM d_sent, unnest(range(1, len(forms))) AS u(i)),
bc AS MATERIALIZED (SELECT prev, w, count(*) AS c FROM bg GROUP BY ALL),
hist AS MATERIALIZED (SELECT prev, sum(c) AS h, count(*) AS n, sum((c + CAST(0.1 AS DOUBLE)) * ln(c + CAST(0.1 AS DOUBLE))) AS s FROM bc GROUP BY prev),
vv AS MATERIALIZED (SELECT CAST(count(DISTINCT f) AS DOUBLE) AS v FROM (SELECT unnest(forms) AS f FROM d_sent))
"""
TRIGRAM = """,
tri AS MATERIALIZED (
  SELECT sid, i AS tid, CASE WHEN i > 1 THEN forms[i - 1] ELSE '<s>' END AS l, forms[i] AS w,
         CASE WHEN i < len(forms) THEN forms[i + 1] ELSE '</s>' END AS r FROM d_sent, unnest(range(1, len(forms) + 1)) AS u(i)
),
tc AS MATERIALIZED (SELECT l, w, r, count(*) AS c FROM tri GROUP BY ALL),
th AS MATERIALIZED (SELECT l, r, sum(c) AS h FROM tc GROUP BY ALL),
vv AS MATERIALIZED (SELECT CAST(count(DISTINCT f) AS DOUBLE) AS v FROM (SELECT unnest(forms) AS f FROM d_sent))
"""
P = "((coalesce({c}, 0) + CAST(0.1 AS DOUBLE)) / (coalesce({h}, 0) + CAST(0.1 AS DOUBLE) * (SELECT v FROM vv)))"

SQL["ngram_sentence_score"] = w(DERIVED) + BIGRAM + f"""
SELECT bg.sid AS sentence_id, count(*) AS n_scored, {R6.format(x='sum(log2(' + P.format(c='bc.c', h='hist.h') + '))')} AS log2_prob
FROM bg JOIN bc USING (prev, w) JOIN hist USING (prev) GROUP BY bg.sid
"""

# a target and its neighbours, from the sentence's own word list
CTX = """,
ctx AS MATERIALIZED (
  SELECT m.sentence_id, m.match_id, s.lang, s.source, substr(m.form_grammatical, 2) AS g, substr(m.form_ungrammatical, 2) AS u,
         CASE WHEN m.match_id > 1 THEN s.forms[m.match_id - 1] ELSE '<s>' END AS l,
         CASE WHEN m.match_id < len(s.forms) THEN s.forms[m.match_id + 1] ELSE '</s>' END AS r
  FROM mps m JOIN d_sent s ON s.sid = m.sentence_id
)"""
V_ = "(SELECT v FROM vv)"
CERT = f"CAST(1 AS DOUBLE) - coalesce(ln(h.h + CAST(0.1 AS DOUBLE) * {V_}) - (h.s + ({V_} - h.n) * CAST(0.1 AS DOUBLE) * ln(CAST(0.1 AS DOUBLE))) / (h.h + CAST(0.1 AS DOUBLE) * {V_}), ln({V_})) / ln({V_})"
TOKSCORE = CTX + """,
ntp AS (
  SELECT c.sentence_id, c.match_id, c.lang, c.source, c.l, """ + P.format(c="cg.c", h="h.h") + " AS pg, " + P.format(c="cu.c", h="h.h") + " AS pu, " + R2.format(x=CERT) + """ AS sure
  FROM ctx c LEFT JOIN bc cg ON cg.prev = c.l AND cg.w = c.g
       LEFT JOIN bc cu ON cu.prev = c.l AND cu.w = c.u LEFT JOIN hist h ON h.prev = c.l
)
"""
MASKSCORE = CTX + """,
mlm AS (
  SELECT c.sentence_id, c.match_id, """ + P.format(c="cg.c", h="h.h") + " AS pg, " + P.format(c="cu.c", h="h.h") + """ AS pu
  FROM ctx c LEFT JOIN tc cg ON cg.l = c.l AND cg.r = c.r AND cg.w = c.g
       LEFT JOIN tc cu ON cu.l = c.l AND cu.r = c.r AND cu.w = c.u LEFT JOIN th h ON h.l = c.l AND h.r = c.r
)
"""
TOKOUT = f"""SELECT sentence_id, match_id, {R6.format(x='pg')} AS p_form_grammatical, {R6.format(x='pu')} AS p_form_ungrammatical,
       {R6.format(x=I.format(p='pg'))} AS I_form_grammatical, {R6.format(x=I.format(p='pu'))} AS I_form_ungrammatical FROM """
SQL["ngram_token_score"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + TOKOUT + "ntp"
SQL["ngram_masked_score"] = w(DERIVED, EDGE_MATCHES) + PAIRS + TRIGRAM + MASKSCORE + TOKOUT + "mlm"

SQL["ood_average"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + PICKS + """,
pk AS (
  SELECT p.sentence_id, p.match_id, regexp_replace(v.form_grammatical, '^ ', '') AS g,
         regexp_replace(v.form_ungrammatical, '^ ', '') AS u, coalesce(a.form, '<s>') AS prev
  FROM picks p JOIN vocab v ON v.pair_pos = p.p
       LEFT JOIN d_tok a ON a.sid = p.sentence_id AND a.tid = p.match_id - 1
),
sc AS (
  SELECT k.sentence_id, k.match_id, """ + P.format(c="cg.c", h="h.h") + " AS pg, " + P.format(c="cu.c", h="h.h") + """ AS pu
  FROM pk k LEFT JOIN bc cg ON cg.prev = k.prev AND cg.w = k.g
       LEFT JOIN bc cu ON cu.prev = k.prev AND cu.w = k.u LEFT JOIN hist h ON h.prev = k.prev
),
av AS (SELECT sentence_id, match_id, avg(pg) AS ag, avg(pu) AS au FROM sc GROUP BY ALL)
SELECT sentence_id, match_id, """ + R6.format(x="ag") + " AS ood_avg_p_grammatical, " + R6.format(x="au") + """ AS ood_avg_p_ungrammatical,
       """ + R6.format(x=I.format(p="ag")) + " AS ood_avg_I_grammatical, " + R6.format(x=I.format(p="au")) + """ AS ood_avg_I_ungrammatical
FROM av
"""

# {by}: grouping, {cols}: its columns
METRICS = """,
a AS (SELECT {cols}, count(*) AS n,
             coalesce(""" + R2.format(x="avg(CAST(coalesce(pg > pu, false) AS INTEGER))") + """, 0.0) AS accuracy,
             """ + R2.format(x="avg(" + I.format(p="pg") + ")") + """ AS avg_I_g,
             """ + R2.format(x="avg(" + I.format(p="pu") + ")") + """ AS avg_I_u, """ + R2.format(x="avg(sure)") + """ AS avg_certainty
      FROM g GROUP BY {by})
SELECT * EXCLUDE (avg_certainty), """ + R2.format(x="avg_I_u - avg_I_g") + """ AS asd,
       CASE WHEN avg_I_g <> 0 THEN round_even((avg_I_u - avg_I_g) / avg_I_g, 0) END AS norm_asd, avg_certainty
FROM a
"""
SQL["metrics_by_group"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + """,
g AS (SELECT lang, pg, pu, sure FROM ntp)""" + METRICS.replace("{cols}", "lang").replace("{by}", "lang")

LONG = """,
lng AS (
  SELECT sentence_id, match_id, 'p_form_grammatical' AS source, 'grammatical' AS x_label, pg AS prob FROM ntp
  UNION ALL
  SELECT sentence_id, match_id, 'p_form_ungrammatical', 'ungrammatical', pu FROM ntp
)
"""
SQL["melt_long"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + LONG + f"""
SELECT sentence_id, match_id, source, x_label, {R6.format(x='prob')} AS prob, {R6.format(x=I.format(p='prob'))} AS surprisal FROM lng
"""
SQL["surprisal_distribution"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + LONG + """,
su AS (SELECT x_label, """ + I.format(p="prob") + """ AS s FROM lng)
SELECT x_label, count(s) AS n, """ + ", ".join(R6.format(x=e) + f" AS {a}" for e, a in [
    ("min(s)", "min"), ("quantile_cont(s, 0.25)", "p25"), ("quantile_cont(s, 0.5)", "median"),
    ("quantile_cont(s, 0.75)", "p75"), ("max(s)", "max"), ("avg(s)", "mean")]) + """
FROM su GROUP BY x_label
"""

SQL["morph_features"] = w(DERIVED) + """
SELECT sentence_id, token_id, form, lemma, upos, xpos, feats__case AS "case", feats__number AS "number" FROM d_lex
"""

SQL["feature_lookup"] = w(DERIVED, EDGE_MATCHES) + PAIRS + """
SELECT m.sid AS sentence_id, m.tid - 1 AS token_id, l.lemma, l.feats__number AS "number", l.feats__case AS "case"
FROM mk m JOIN d_lex l ON l.sentence_id = m.sid AND l.token_id = m.tid - 1
"""

SQL["metrics_rollup"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + """,
g AS (SELECT nullif(lang, 'es') AS lang, source, pg, pu, sure FROM ntp)""" + METRICS.replace(
    "{cols}", "lang, source, grouping_id(lang, source) AS level").replace("{by}", "ROLLUP (lang, source)")

SQL["scores_row_limit"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + TOKOUT + """
(SELECT n.* FROM ntp n JOIN (SELECT sentence_id, match_id FROM mps ORDER BY sentence_id, match_id LIMIT 100) f
 USING (sentence_id, match_id))
"""

SQL["histogram"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + LONG + """
SELECT x_label, CAST(floor(""" + I.format(p="prob") + """) AS BIGINT) AS bin, count(*) AS n FROM lng GROUP BY ALL
"""

# --- CoNLL-U text made from the derived treebank: every word tid % 4 = 0 gets a subtype ---------
SUB = "CASE WHEN tid % 4 = 0 THEN deprel || ':x' ELSE deprel END"
SQL["conllu_parse"] = w(DERIVED) + f"""
SELECT sid AS sentence_id, pos, CAST(tid AS VARCHAR) AS id, tid, CAST(NULL AS INTEGER) AS range_from, CAST(NULL AS INTEGER) AS range_to, form, lemma,
       upos, num AS feats__number, cas AS feats__case, head, {SUB} AS deprel FROM d_tok
UNION ALL
SELECT sid, pos, id, NULL, 2, 3, form, '_', NULL, NULL, NULL, NULL, NULL FROM d_rng
"""
SQL["conllu_two_files"] = w(DERIVED, EDGE_MATCHES.replace("n.deprel = 'nsubj'", "n.deprel = 'nsubj' AND n.tid % 4 <> 0")) + """
SELECT regexp_replace(sid, '^.*-', '') AS sentence_id, tid AS match_id, form AS match_token, trim(text, ' ' || chr(9)) AS original_text,
       substr(text, 1, CAST(off0 AS BIGINT)) || '[MASK]' || substr(text, CAST(off0 + length(form) + 1 AS BIGINT)) AS masked_text
FROM surf WHERE NOT inside
"""
SQL["conllu_mixed_endings"] = SQL["lexicon_filter"]
SQL["pattern_subtype"] = w(DERIVED) + """
SELECT DISTINCT n.sid AS sentence_id, n.tid AS match_id FROM d_tok n JOIN d_tok v ON v.sid = n.sid AND v.tid = n.head
WHERE n.upos = 'NOUN' AND v.upos = 'VERB' AND n.deprel = 'nsubj' AND n.tid % 4 = 0
"""
SQL["lexicon_nan"] = w(DERIVED) + """
SELECT sentence_id, token_id, form, CASE WHEN lemma <> 'and' THEN lemma END AS lemma, upos, xpos, feats__case, feats__number FROM d_lex
"""
SQL["lexicon_csv_roundtrip"] = SQL["minimal_pairs"]
SQL["lexicon_foreign_csv"] = SQL["minimal_pairs"]
SQL["evaluation_csv"] = SQL["ngram_token_score"]
SQL["exceptions_csv"] = SQL["exception_legacy"]
SQL["task_table_csv"] = SQL["task_batch"]
SQL["masked_custom"] = SQL["masked_dataset"].replace("'[MASK]'", "'<mask>'")
SQL["pairs_csv_roundtrip"] = SQL["minimal_pairs_spaced"]
SQL["upos_override"] = w(DERIVED, EDGE_MATCHES) + PAIRS + """,
vi AS (SELECT lemma, """ + UP.format(f="form") + """ AS up, first(form ORDER BY doc_id, ln, tid) AS alt
       FROM d_lex WHERE upos = 'VERB' AND feats__number = 'Plur' AND feats__case IS NULL GROUP BY ALL)
SELECT o.sid AS sentence_id, o.tid AS match_id, o.form AS form_grammatical, v.alt AS form_ungrammatical
FROM own o JOIN vi v ON v.lemma = o.lemma AND v.up = """ + UP.format(f="o.form") + " WHERE v.alt <> o.form"
SQL["ood_array"] = SQL["ood_pairs"].replace("SELECT p.sentence_id, p.match_id, p.pick, v.form_grammatical AS ood_form_grammatical,", "SELECT p.sentence_id, p.match_id, string_agg(v.form_grammatical || '>' ||").replace(
    "       v.form_ungrammatical AS ood_form_ungrammatical\nFROM picks p JOIN vocab v ON v.pair_pos = p.p", "       v.form_ungrammatical, ';' ORDER BY p.pick) AS ood\nFROM picks p JOIN vocab v ON v.pair_pos = p.p GROUP BY ALL")
SQL["evaluate_from_table"] = SQL["ngram_token_score"]
SQL["many_targets"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + f""",
third AS (SELECT c.sentence_id, c.match_id, {P.format(c='b.c', h='h.h')} AS pl
          FROM ctx c LEFT JOIN bc b ON b.prev = c.l AND b.w = lower(substr(c.g, 1, 4)) LEFT JOIN hist h ON h.prev = c.l)
SELECT sentence_id, match_id, {R6.format(x='pg')} AS p_form_grammatical, {R6.format(x='pu')} AS p_form_ungrammatical, {R6.format(x='pl')} AS p_lemma
FROM ntp JOIN third USING (sentence_id, match_id)
"""
SQL["ngram_certainty"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + TOKSCORE + f"""
SELECT sentence_id, match_id, sure AS certainty FROM ntp
"""
# every filled-in sentence is scored from its own word list
FILL = """,
fill AS (SELECT m.sentence_id, m.match_id, s.forms, list_concat(list_concat(s.forms[1:m.match_id - 1], [substr(m.form_ungrammatical, 2)]), s.forms[m.match_id + 1:]) AS uforms
         FROM mps m JOIN d_sent s ON s.sid = m.sentence_id),
steps AS (SELECT sentence_id, match_id, k, f[i] AS prev, f[i + 1] AS w
          FROM (SELECT sentence_id, match_id, 'g' AS k, forms AS f FROM fill UNION ALL SELECT sentence_id, match_id, 'u', uforms FROM fill),
               unnest(range(1, len(f))) AS t(i)),
sums AS (SELECT sentence_id, match_id, k, count(*) AS n, sum(log2(""" + P.format(c="b.c", h="h.h") + """)) AS s
         FROM steps x LEFT JOIN bc b ON b.prev = x.prev AND b.w = x.w LEFT JOIN hist h ON h.prev = x.prev GROUP BY ALL)
"""
SQL["ngram_sentence_pairs"] = w(DERIVED, EDGE_MATCHES) + PAIRS + BIGRAM + FILL + f"""
SELECT m.sentence_id, m.match_id, coalesce(g.n, 0) AS n_scored, {R6.format(x='coalesce(g.s, 0)')} AS p_form_grammatical,
       {R6.format(x='coalesce(u.s, 0)')} AS p_form_ungrammatical
FROM mps m LEFT JOIN sums g ON g.sentence_id = m.sentence_id AND g.match_id = m.match_id AND g.k = 'g'
     LEFT JOIN sums u ON u.sentence_id = m.sentence_id AND u.match_id = m.match_id AND u.k = 'u'
"""
# the same with every word masked in turn
SQL["masked_sentence_pairs"] = w(DERIVED, EDGE_MATCHES) + PAIRS + TRIGRAM + """,
fill AS (SELECT m.sentence_id, m.match_id, s.forms, list_concat(list_concat(s.forms[1:m.match_id - 1], [substr(m.form_ungrammatical, 2)]), s.forms[m.match_id + 1:]) AS uforms
         FROM mps m JOIN d_sent s ON s.sid = m.sentence_id),
steps AS (SELECT sentence_id, match_id, k, CASE WHEN i > 1 THEN f[i - 1] ELSE '<s>' END AS l, f[i] AS w, CASE WHEN i < len(f) THEN f[i + 1] ELSE '</s>' END AS r
          FROM (SELECT sentence_id, match_id, 'g' AS k, forms AS f FROM fill UNION ALL SELECT sentence_id, match_id, 'u', uforms FROM fill),
               unnest(range(1, len(f) + 1)) AS t(i)),
sums AS (SELECT sentence_id, match_id, count(*) FILTER (k = 'g') AS n, sum(lp) FILTER (k = 'g') AS g, sum(lp) FILTER (k = 'u') AS u
         FROM (SELECT x.*, log2(""" + P.format(c="tc.c", h="th.h") + """) AS lp FROM steps x LEFT JOIN tc ON tc.l = x.l AND tc.r = x.r AND tc.w = x.w
               LEFT JOIN th ON th.l = x.l AND th.r = x.r) GROUP BY ALL)
""" + f"SELECT sentence_id, match_id, n AS n_scored, {R6.format(x='g')} AS p_form_grammatical, {R6.format(x='u')} AS p_form_ungrammatical FROM sums"

# words split greedily into pieces of 2 to 4 characters that occur 200 times, and single characters; then the chain rule
PIECES = CTX + """,
wc AS MATERIALIZED (SELECT w, count(*) AS c FROM (SELECT unnest(forms) AS w FROM d_sent) GROUP BY w),
pt AS MATERIALIZED (SELECT substr(w, p, n) AS piece FROM wc, range(2, 5) AS a(n), unnest(range(1, greatest(length(w) - n + 2, 1))) AS b(p) GROUP BY 1 HAVING sum(c) >= 200),
cut AS MATERIALIZED (
  WITH RECURSIVE walk(w, i, pos, piece) AS (
    SELECT w, 0, 1, '' FROM wc
    UNION ALL
    SELECT k.w, k.i + 1, k.pos + n.n, substr(k.w, k.pos, n.n) FROM walk k, LATERAL (
      SELECT CASE WHEN k.pos + 3 <= length(k.w) AND substr(k.w, k.pos, 4) IN (SELECT piece FROM pt) THEN 4
                  WHEN k.pos + 2 <= length(k.w) AND substr(k.w, k.pos, 3) IN (SELECT piece FROM pt) THEN 3
                  WHEN k.pos + 1 <= length(k.w) AND substr(k.w, k.pos, 2) IN (SELECT piece FROM pt) THEN 2 ELSE 1 END AS n) n
    WHERE k.pos <= length(k.w))
  SELECT w, list(piece ORDER BY i) AS ps FROM walk WHERE i > 0 GROUP BY w),
pv AS (SELECT CAST(count(DISTINCT x) AS DOUBLE) AS v FROM (SELECT unnest(ps) AS x FROM cut)),
"""
# {seq}: pieces of a sentence; targets are words of the corpus
PIECE_SENT = """
sp AS MATERIALIZED (SELECT sid, list(x ORDER BY t, i) AS f FROM (SELECT s.sid, s.t, unnest(ps) AS x, generate_subscripts(ps, 1) AS i
       FROM (SELECT sid, unnest(forms) AS w, generate_subscripts(forms, 1) AS t FROM d_sent) s JOIN cut USING (w)) GROUP BY sid),
"""
PIECE_TARGETS = """
tg AS (SELECT c.sentence_id, c.match_id, k.k, cut.ps, coalesce(b.ps[-1], '<s>') AS before, coalesce(a.ps[1], '</s>') AS after
       FROM ctx c CROSS JOIN (VALUES ('g'), ('u')) k(k) JOIN cut ON cut.w = CASE k.k WHEN 'g' THEN c.g ELSE c.u END
       LEFT JOIN cut b ON b.w = c.l LEFT JOIN cut a ON a.w = c.r),
st AS (SELECT sentence_id, match_id, k, i, CASE WHEN i = 1 THEN before ELSE ps[i - 1] END AS l, ps[i] AS w, after AS r FROM tg, unnest(range(1, len(ps) + 1)) AS t(i)),
"""
PIECE_OUT = """
pr AS (SELECT sentence_id, match_id, k, i, (coalesce(c, 0) + 0.1::DOUBLE) / (coalesce(h, 0) + 0.1::DOUBLE * (SELECT v FROM pv)) AS p,
              CASE WHEN h IS NULL THEN ln((SELECT v FROM pv)) ELSE ln(h + 0.1::DOUBLE * (SELECT v FROM pv))
                   - (s + ((SELECT v FROM pv) - n) * 0.1::DOUBLE * ln(0.1::DOUBLE)) / (h + 0.1::DOUBLE * (SELECT v FROM pv)) END AS e FROM lk),
pp AS (SELECT sentence_id, match_id, k, exp(sum(ln(greatest(p, 1e-12::DOUBLE)))) AS p, count(*) AS n,
              max(CASE WHEN i = 1 THEN """ + R2.format(x="1.0::DOUBLE - e / ln((SELECT v FROM pv))") + """ END) AS sure FROM pr GROUP BY ALL)
SELECT sentence_id, match_id, max(n) FILTER (k = 'g') AS n_pieces_form_grammatical, max(n) FILTER (k = 'u') AS n_pieces_form_ungrammatical,
       """ + R6.format(x="max(-log2(p)) FILTER (k = 'g')") + " AS I_form_grammatical, " + R6.format(x="max(-log2(p)) FILTER (k = 'u')") + """ AS I_form_ungrammatical,
       max(sure) AS certainty FROM pp GROUP BY sentence_id, match_id
"""
HALF = "sum((c + 0.1::DOUBLE) * ln(c + 0.1::DOUBLE)) AS s"
SQL["ngram_piece_score"] = w(DERIVED, EDGE_MATCHES) + PAIRS + PIECES + PIECE_SENT + PIECE_TARGETS + f"""
pb AS MATERIALIZED (SELECT f[i] AS l, f[i + 1] AS w, count(*) AS c FROM sp, unnest(range(1, len(f))) AS t(i) GROUP BY ALL),
ph AS MATERIALIZED (SELECT l, sum(c) AS h, count(*) AS n, {HALF} FROM pb GROUP BY l),
lk AS (SELECT st.*, pb.c, ph.h, ph.n, ph.s FROM st LEFT JOIN pb ON pb.l = st.l AND pb.w = st.w LEFT JOIN ph ON ph.l = st.l),
""" + PIECE_OUT
SQL["masked_piece_score"] = w(DERIVED, EDGE_MATCHES) + PAIRS + PIECES + PIECE_SENT + PIECE_TARGETS + f"""
pb AS MATERIALIZED (SELECT CASE WHEN i > 1 THEN f[i - 1] ELSE '<s>' END AS l, f[i] AS w, CASE WHEN i < len(f) THEN f[i + 1] ELSE '</s>' END AS r, count(*) AS c
       FROM sp, unnest(range(1, len(f) + 1)) AS t(i) GROUP BY ALL),
ph AS MATERIALIZED (SELECT l, r, sum(c) AS h, count(*) AS n, {HALF} FROM pb GROUP BY l, r),
lk AS (SELECT st.*, pb.c, ph.h, ph.n, ph.s FROM st LEFT JOIN pb ON pb.l = st.l AND pb.w = st.w AND pb.r = st.r LEFT JOIN ph ON ph.l = st.l AND ph.r = st.r),
""" + PIECE_OUT
SQL["evaluate_contract"] = w(DERIVED, EDGE_MATCHES) + PAIRS + f"""
SELECT sentence_id, match_id, {R6.format(x='length(form_grammatical) / CAST(length(masked_text) AS DOUBLE)')} AS p_form_grammatical,
       {R6.format(x='length(form_ungrammatical) / CAST(length(masked_text) AS DOUBLE)')} AS p_form_ungrammatical,
       {R6.format(x='CAST(1 AS DOUBLE) / length(masked_text)')} AS certainty
FROM mp
"""

SQL["pattern_edge_tokens"] = SQL["pattern_edge"]
