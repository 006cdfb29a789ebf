"""DuckDB SQL that recomputes the registered queries independently.

The SQL redraws the same seeded shuffles and splits from md5 keys (DuckDB
has md5 too), splits sentences and words with the same regexes, and
aggregates with its own engine. Used by ``__spark_entry__.oracle_sql`` and
by the tests. Values are rounded to 9 decimals as on the Spark side.
"""

from __future__ import annotations

SEED = 42
K_MAX = 20
ENUM_SIZES = (2, 3, 4, 5, 6)  # sizes enumerated for K_MAX = 20
R = 9

RECS = """recs AS (
  SELECT doc_id AS record_id, text AS summary, source FROM documents
  WHERE text IS NOT NULL AND text <> '')"""
BENCH_RECS = """recs AS (
  SELECT item_id AS record_id, text AS summary, NULL::VARCHAR AS source FROM benchmark
  WHERE text IS NOT NULL AND text <> '')"""

SENT = r"""sent AS (
  SELECT record_id, source, summary,
         list_filter(string_split(regexp_replace(
             regexp_replace(summary, '\A[ \t\r\n]+|[ \t\r\n]+\z', '', 'g'),
             '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sentences
  FROM recs)"""

PLAN = f"""plan AS (
  SELECT *, len(sentences) AS n,
         CASE WHEN len(sentences) = 0 THEN []::BIGINT[]
              WHEN len(list_distinct(sentences)) = len(sentences) THEN range(0, len(sentences))
              ELSE list_transform(sentences, lambda x: list_position(sentences, x) - 1) END AS canon,
         CASE WHEN len(sentences) < 2 THEN 0
              WHEN len(sentences) <= 12 THEN least(factorial(len(sentences)::INTEGER) - 1, {K_MAX})::INTEGER
              ELSE {K_MAX} END AS want
  FROM sent),
plan2 AS MATERIALIZED (
  SELECT *, CASE WHEN want <= 0 THEN 'none'
                 WHEN n IN ({", ".join(str(n) for n in ENUM_SIZES)}) THEN 'enumerate'
                 ELSE 'sample' END AS method
  FROM plan)"""

PERM = f"""perm(pn, p) AS (
  SELECT pn, [i] FROM (SELECT pn, unnest(range(0, pn)) AS i
                       FROM (SELECT unnest([{", ".join(str(n) for n in ENUM_SIZES)}]) AS pn))
  UNION ALL
  SELECT pn, list_append(p, i) FROM (SELECT pn, p, unnest(range(0, pn)) AS i FROM perm WHERE len(p) < pn)
  WHERE NOT list_contains(p, i))"""

SHUFFLES = f"""enum_c AS (
  SELECT c.record_id, c.want, c.canon, list_transform(q.p, lambda i: c.canon[i + 1]) AS t
  FROM plan2 c JOIN perm q ON q.pn = c.n AND len(q.p) = c.n WHERE c.method = 'enumerate'),
enum_d AS (SELECT DISTINCT record_id, want, t FROM enum_c WHERE t <> canon),
enum_s AS (
  SELECT record_id, want, t,
         row_number() OVER (PARTITION BY record_id
           ORDER BY md5(concat_ws('|', {SEED}, record_id, 'p', array_to_string(t, ',')))) AS k
  FROM enum_d QUALIFY k <= want),
enum_t AS (
  SELECT e.record_id, e.want, e.t, e.k, array_to_string(list_transform(e.t, lambda i: p.sentences[i + 1]), ' ') AS joined
  FROM enum_s e JOIN plan2 p USING (record_id)),
enum_u AS (SELECT record_id, want, arg_min(t, k) AS t, min(k) AS k FROM enum_t GROUP BY record_id, want, joined),
enum_r AS (SELECT record_id, want, t, row_number() OVER (PARTITION BY record_id ORDER BY k) AS cand_idx FROM enum_u),
att_rows AS (
  SELECT record_id, want, canon, n, unnest(range(1, want * 5 + 11)) AS j FROM plan2 WHERE method = 'sample'),
att_pos AS (SELECT record_id, want, canon, j, unnest(range(0, n)) AS i FROM att_rows),
att AS (
  SELECT record_id, j, any_value(want) AS want, any_value(canon) AS canon,
         list(canon[i + 1] ORDER BY substr(md5(concat_ws('|', {SEED}, record_id, j, i // 4)), (8 * (i % 4) + 1)::INTEGER, 8), i) AS t
  FROM att_pos GROUP BY record_id, j),
att_d AS (SELECT record_id, want, t, min(j) AS j FROM att WHERE t <> canon GROUP BY record_id, want, t),
att_t AS (
  SELECT a.record_id, a.want, a.t, a.j, array_to_string(list_transform(a.t, lambda i: p.sentences[i + 1]), ' ') AS joined
  FROM att_d a JOIN plan2 p USING (record_id)),
att_first AS (SELECT record_id, want, arg_min(t, j) AS t, min(j) AS j FROM att_t GROUP BY record_id, want, joined),
samp_r AS (
  SELECT record_id, want, t, row_number() OVER (PARTITION BY record_id ORDER BY j) AS cand_idx FROM att_first),
negs AS MATERIALIZED (
  SELECT record_id, cand_idx, t FROM enum_r WHERE cand_idx <= want
  UNION ALL
  SELECT record_id, cand_idx, t FROM samp_r WHERE cand_idx <= want)"""

SCORES = r"""words AS MATERIALIZED (
  SELECT record_id, idx,
         list_distinct(list_filter(regexp_split_to_array(lower(s), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w
  FROM (SELECT record_id, unnest(range(0, len(sentences))) AS idx, unnest(sentences) AS s FROM plan2)),
cands AS (
  SELECT record_id, 0 AS cand_idx, canon AS t FROM plan2 WHERE n >= 2
  UNION ALL SELECT record_id, cand_idx, t FROM negs),
pairs AS (
  SELECT record_id, cand_idx, t[i] AS a, t[i + 1] AS b
  FROM (SELECT record_id, cand_idx, t, unnest(range(1, len(t))) AS i FROM cands)),
pair_sz AS (
  SELECT p.record_id, p.cand_idx, len(list_intersect(wa.w, wb.w)) AS sh, len(wa.w) + len(wb.w) AS sz
  FROM pairs p JOIN words wa ON wa.record_id = p.record_id AND wa.idx = p.a
  JOIN words wb ON wb.record_id = p.record_id AND wb.idx = p.b),
scores AS MATERIALIZED (
  SELECT record_id, cand_idx,
         CASE WHEN sum(sz) - sum(sh) > 0 THEN sum(sh)::DOUBLE / (sum(sz) - sum(sh))::DOUBLE ELSE 0.0::DOUBLE END
           AS score
  FROM pair_sz GROUP BY record_id, cand_idx),
items AS MATERIALIZED (
  SELECT o.record_id, any_value(o.score) AS pos, count(x.score) AS n_neg,
         (1 + count_if(x.score > o.score))::INTEGER AS rnk,
         count_if(o.score > x.score)::INTEGER AS wins, max(x.score) AS max_neg
  FROM scores o JOIN scores x ON x.record_id = o.record_id AND x.cand_idx > 0
  WHERE o.cand_idx = 0 GROUP BY o.record_id)"""


def cte(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


def shuffles_with(recs: str = RECS, *more: str) -> str:
    return cte(recs, SENT, PLAN, PERM, SHUFFLES, *more, recursive=True)


def scored_with(recs: str = RECS, *more: str) -> str:
    return cte(recs, SENT, PLAN, PERM, SHUFFLES, SCORES, *more, recursive=True)


def _rd(expr: str) -> str:
    return f"round(coalesce(({expr})::DOUBLE, 0.0), {R})"


def report_select(ks=(3, 5, 10), total: str = "(SELECT count(*) FROM recs)", where: str = "") -> str:
    """One-row ranking report over ``items`` (and ``scores`` for negatives)."""
    cols = [
        f"{total}::BIGINT AS total_items_in_dataset",
        "count(*)::BIGINT AS evaluated_items_count",
        "coalesce(count_if(rnk = 1), 0)::BIGINT AS top_1_success_count",
        "coalesce(count_if(rnk > 1), 0)::BIGINT AS top_1_failure_count",
        _rd("avg(CASE WHEN rnk = 1 THEN 1.0 ELSE 0.0 END::DOUBLE)") + " AS top_1_accuracy",
        _rd("avg(1.0::DOUBLE / rnk)") + " AS mean_reciprocal_rank",
        _rd("sum(wins)::DOUBLE / nullif(sum(n_neg), 0)") + " AS pair_ranking_accuracy",
        "coalesce(sum(wins), 0)::BIGINT AS pair_correct_count",
        "coalesce(sum(n_neg), 0)::BIGINT AS pair_total_count",
        _rd("avg(n_neg::DOUBLE)") + " AS avg_len_shuffled",
        _rd("avg(CASE WHEN rnk = 1 THEN n_neg::DOUBLE END)") + " AS avg_len_shuffled_success",
        _rd("avg(CASE WHEN rnk > 1 THEN n_neg::DOUBLE END)") + " AS avg_len_shuffled_failure",
        _rd("avg(pos)") + " AS avg_positive_score",
        _rd("stddev_pop(pos)") + " AS std_positive_score",
        _rd("(SELECT avg(score) FROM scores WHERE cand_idx > 0" + (f" AND {where}" if where else "") + ")")
        + " AS avg_negative_score",
        _rd("(SELECT stddev_pop(score) FROM scores WHERE cand_idx > 0" + (f" AND {where}" if where else "") + ")")
        + " AS std_negative_score",
        _rd("avg(CASE WHEN rnk = 1 THEN pos - max_neg END)") + " AS avg_margin_victory",
        _rd("avg(CASE WHEN rnk > 1 THEN max_neg - pos END)") + " AS avg_margin_defeat",
    ]
    cols += [_rd(f"avg(CASE WHEN rnk <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE)") + f" AS recall_at_{k}" for k in ks]
    cols += [_rd(f"avg(CASE WHEN rnk <= {k} THEN 1.0::DOUBLE / log2(rnk + 1) ELSE 0.0::DOUBLE END)")
             + f" AS ndcg_at_{k}" for k in ks]
    return "SELECT " + ",\n  ".join(cols) + "\nFROM items" + (f" WHERE {where}" if where else "")


# ---------------------------------------------------------------- per query
THRESHOLD = 0.03125  # logit threshold of the fixed two-class model over scores
EDGE = r"'\A[ \t\r\n]+|[ \t\r\n]+\z'"

REPORT_COLS = [
    "total_items_in_dataset", "evaluated_items_count", "top_1_success_count", "top_1_failure_count",
    "top_1_accuracy", "mean_reciprocal_rank", "pair_ranking_accuracy", "pair_correct_count", "pair_total_count",
    "avg_len_shuffled", "avg_len_shuffled_success", "avg_len_shuffled_failure", "avg_positive_score",
    "std_positive_score", "avg_negative_score", "std_negative_score", "avg_margin_victory", "avg_margin_defeat",
    "recall_at_3", "recall_at_5", "recall_at_10", "ndcg_at_3", "ndcg_at_5", "ndcg_at_10",
]
INT_METRICS = {"total_items_in_dataset", "evaluated_items_count", "top_1_success_count",
               "top_1_failure_count", "pair_correct_count", "pair_total_count"}


def report(cols=None) -> str:
    sql = scored_with() + "\n" + report_select()
    if cols:
        return f"SELECT {', '.join(cols)} FROM ({sql})"
    return sql


def report_rows() -> str:
    names = [_reported(c) for c in REPORT_COLS]
    parts = []
    for i, (c, m) in enumerate(zip(REPORT_COLS, names)):
        if m in INT_METRICS and m not in ("top_1_success_count", "top_1_failure_count"):
            text = f"CAST({c} AS BIGINT)::VARCHAR"
        elif m in ("top_1_success_count", "top_1_failure_count"):
            text = f"CASE WHEN evaluated_items_count = 0 THEN printf('%.4f', {c}::DOUBLE) ELSE {c}::VARCHAR END"
        elif "std_" in m or "margin_" in m:
            text = f"printf('%.6f', {c})"
        else:
            text = f"printf('%.4f', {c})"
        parts.append(f"SELECT {i + 1}::INTEGER AS ord, '{m}' AS metric, round({c}::DOUBLE, {R}) AS value, "
                     f"{text} AS text FROM rep")
    return scored_with() + ",\nrep AS (" + report_select() + ")\n" + "\nUNION ALL ".join(parts)


def items_sql(select: str) -> str:
    return scored_with() + "\n" + select


def logits_cte(source: str = "scores") -> str:
    """p1/p0 of the fixed model: logits [0, score - T], max-shifted softmax."""
    return f"""lg AS (
  SELECT record_id, cand_idx, CASE WHEN cand_idx = 0 THEN 1 ELSE 0 END AS y,
         0.0::DOUBLE AS l0, score - {THRESHOLD}::DOUBLE AS l1 FROM {source}),
lg2 AS (SELECT *, greatest(l0, l1) AS m FROM lg),
probs AS (
  SELECT record_id, cand_idx, y, l0, l1, m,
         exp(l0 - m) / (exp(l0 - m) + exp(l1 - m)) AS p0,
         exp(l1 - m) / (exp(l0 - m) + exp(l1 - m)) AS p1
  FROM lg2),
pred AS (SELECT *, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS y_pred FROM probs)"""


ALL_SCORES = """all_scores AS (
  SELECT p.record_id, 0 AS cand_idx, coalesce(s.score, 0.0::DOUBLE) AS score
  FROM plan2 p LEFT JOIN scores s ON s.record_id = p.record_id AND s.cand_idx = 0
  UNION ALL SELECT record_id, cand_idx, score FROM scores WHERE cand_idx > 0)"""

CLASS_AGG = f"""areas AS (
  SELECT p1, count_if(y = 1) AS pos, count_if(y <> 1) AS neg,
         count_if(y = 1 AND y_pred = 1) AS tp, count_if(y <> 1 AND y_pred = 1) AS fp,
         count_if(y = 1 AND y_pred <> 1) AS fn, count_if(y = y_pred) AS correct
  FROM pred GROUP BY p1),
cum AS (
  SELECT *, sum(pos) OVER (ORDER BY p1 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
            sum(neg) OVER (ORDER BY p1 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
  FROM areas),
fin AS (
  SELECT sum(neg * (cp - 0.5 * pos))::DOUBLE AS auc_num,
         sum(CASE WHEN pos > 0 THEN pos * (cp::DOUBLE / (cp + cn)::DOUBLE) END) AS ap_num,
         sum(pos) AS P, sum(neg) AS N, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(correct) AS correct
  FROM cum)"""

CLASS_SELECT = f"""SELECT
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END, {R}) AS f1,
  round(CASE WHEN P > 0 AND N > 0 THEN auc_num / (P::DOUBLE * N::DOUBLE) END, {R}) AS roc_auc,
  round(coalesce(correct::DOUBLE / nullif(P + N, 0)::DOUBLE, 0.0), {R}) AS accuracy,
  round(CASE WHEN P > 0 THEN ap_num / P::DOUBLE END, {R}) AS pr_auc
FROM fin"""


def classification(cols=("f1", "roc_auc", "accuracy", "pr_auc")) -> str:
    sql = scored_with(RECS, ALL_SCORES, logits_cte("all_scores"), CLASS_AGG) + "\n" + CLASS_SELECT
    return f"SELECT {', '.join(cols)} FROM ({sql})"


def log_pt() -> str:
    """log softmax at the label, from the logits CTE."""
    return "(CASE WHEN y = 1 THEN l1 ELSE l0 END) - m - ln(exp(l0 - m) + exp(l1 - m))"


def splits_random(folds: int, test: float, val: float, no_test: bool) -> str:
    """Long table (fold, role, record_id) of independent seeded reshuffles."""
    val_eff = f"({val}::DOUBLE / (1 - {test}::DOUBLE))" if (1 - test) > 0 else "0.0::DOUBLE"
    keys = f"""k AS (
  SELECT f.fold::INTEGER AS fold, r.record_id,
         ('0x' || substr(md5(concat_ws('|', {SEED}, 'split', f.fold, 'test', r.record_id)), 1, 15))::BIGINT AS kt,
         ('0x' || substr(md5(concat_ws('|', {SEED}, 'split', f.fold, 'val', r.record_id)), 1, 15))::BIGINT AS kv
  FROM recs r, (SELECT unnest(range(1, {folds + 1})) AS fold) f),
n AS (SELECT count(*) AS n FROM recs),
t AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY kt, record_id) AS rt FROM k),
t2 AS (SELECT t.*, rt <= floor(n.n::DOUBLE * {test}::DOUBLE) AS is_test FROM t, n),"""
    if no_test:
        return "WITH " + RECS + ",\n" + keys.rstrip(",") + """
SELECT fold, CASE WHEN is_test THEN 'val' ELSE 'train' END AS role, record_id FROM t2"""
    return "WITH " + RECS + ",\n" + keys + f"""
rest AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY kv, record_id) AS rv FROM t2 WHERE NOT is_test),
m AS (SELECT fold, count(*) AS nr FROM rest GROUP BY fold)
SELECT fold, 'test' AS role, record_id FROM t2 WHERE is_test
UNION ALL
SELECT rest.fold, CASE WHEN rv <= floor(m.nr::DOUBLE * {val_eff}) THEN 'val' ELSE 'train' END AS role, record_id
FROM rest JOIN m USING (fold)"""


GROUPS = f"""grp AS (
  SELECT source AS "group", min(record_id) AS first_seen FROM recs GROUP BY source),
grp2 AS (SELECT *, row_number() OVER (ORDER BY first_seen)::INTEGER AS position FROM grp),
ng AS (SELECT count(*) AS g FROM grp2),
plan_g AS (
  SELECT a.position AS fold, a."group" AS test_group,
         (('0x' || substr(md5(concat_ws('|', {SEED}, 'group', a.position)), 1, 15))::BIGINT % (ng.g - 1)) + 1 AS r
  FROM grp2 a, ng),
plan_v AS (
  SELECT fold, test_group, CASE WHEN r < fold THEN r ELSE r + 1 END AS val_pos FROM plan_g),
folds_g AS (
  SELECT v.fold, v.test_group, b."group" AS val_group FROM plan_v v JOIN grp2 b ON b.position = v.val_pos)"""


def group_roles() -> str:
    return cte(RECS, GROUPS) + """,
vals AS (SELECT val_group, string_agg(fold::VARCHAR, ',' ORDER BY fold) AS val_folds FROM folds_g GROUP BY val_group)
SELECT r.record_id, f.fold::INTEGER AS test_fold, coalesce(v.val_folds, '') AS val_folds
FROM recs r JOIN folds_g f ON f.test_group IS NOT DISTINCT FROM r.source
LEFT JOIN vals v ON v.val_group IS NOT DISTINCT FROM r.source"""


KEY_MEMBERSHIP = """fm AS (
  SELECT r.record_id, g.position AS fold FROM recs r JOIN grp2 g ON g."group" IS NOT DISTINCT FROM r.source)"""


def random_membership(folds: int, test: float) -> str:
    """``fm(record_id, fold)``: test membership of independent seeded reshuffles."""
    return f"""fk AS (
  SELECT f.fold::INTEGER AS fold, r.record_id,
         ('0x' || substr(md5(concat_ws('|', {SEED}, 'split', f.fold, 'test', r.record_id)), 1, 15))::BIGINT AS kt
  FROM recs r, (SELECT unnest(range(1, {folds + 1})) AS fold) f),
frank AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY kt, record_id) AS rt FROM fk),
fm AS (
  SELECT record_id, fold FROM frank
  WHERE rt <= floor((SELECT count(*) FROM recs)::DOUBLE * {test}::DOUBLE))"""


def _reported(column: str) -> str:
    return column.replace("recall_at_", "recall@").replace("ndcg_at_", "ndcg@")


def newton(d: int, classes: int, steps: int) -> list[str]:
    """CTEs of full Newton steps for softmax models, to ``t<steps>(model, t_0, t_1, ..)``.

    Reads ``tr(model, y, a, x1 .. xd)`` (weighted training rows of each model)
    and ``reg(model, reg)``. Parameters go class by class, the bias first;
    class 0 has none. The linear systems are solved by elimination.
    """
    n, xs = (classes - 1) * (d + 1), ["1.0::DOUBLE"] + [f"x{j}" for j in range(1, d + 1)]
    spread = ", ".join(f"(sum(a * x{j} * x{j}) - pow(sum(a * x{j}), 2) / sum(a)) / (sum(a) - sum(a * a) / sum(a)) AS v{j}"
                       for j in range(1, d + 1))
    out = [f"st AS MATERIALIZED (SELECT model, sum(a) AS z, {spread} FROM tr GROUP BY model)",
           "t0 AS (SELECT model, " + ", ".join(f"0.0::DOUBLE AS t_{i}" for i in range(n)) + " FROM st)"]
    kept = ", ".join(f"t_{i}" for i in range(n))
    cls = range(1, classes)
    part = [divmod(i, d + 1) for i in range(n)]  # (class - 1, feature) of a parameter
    for s in range(steps):
        logit = ", ".join("exp(" + " + ".join(f"t_{(c - 1) * (d + 1) + j} * {xs[j]}" for j in range(d + 1)) + f") AS e{c}" for c in cls)
        total = "1.0 + " + " + ".join(f"e{c}" for c in cls)
        out.append(f"e_{s} AS (SELECT tr.*, {logit} FROM tr JOIN t{s} USING (model))")
        out.append(f"q_{s} AS (SELECT *, " + ", ".join(f"e{c} / ({total}) AS p{c}" for c in cls) + f" FROM e_{s})")
        sums = [f"sum(a * (p{c + 1} - CASE WHEN y = {c + 1} THEN 1.0 ELSE 0.0 END) * {xs[j]}) AS g_{i}" for i, (c, j) in enumerate(part)]
        sums += [f"sum(a * p{c + 1} * ({1.0 if c == b else 0.0} - p{b + 1}) * {xs[j]} * {xs[k]}) AS h_{i}_{m}"
                 for i, (c, j) in enumerate(part) for m, (b, k) in enumerate(part)]
        out.append(f"g_{s} AS MATERIALIZED (SELECT model, {', '.join(sums)} FROM q_{s} GROUP BY model)")
        cells = [f"h_{i}_{m} / z" + (f" + reg * v{j}" if i == m and j else "") + f" AS a_{i}_{m}" for i, (_, j) in enumerate(part) for m in range(n)]
        cells += [f"g_{i} / z" + (f" + reg * v{j} * t_{i}" if j else "") + f" AS b_{i}" for i, (_, j) in enumerate(part)]
        out.append(f"m_{s}_0 AS MATERIALIZED (SELECT model, {kept}, {', '.join(cells)} FROM g_{s} JOIN st USING (model) "
                   f"JOIN t{s} USING (model) JOIN reg USING (model))")
        for c in range(n):
            cells = [(f"a_{c}_{m} / a_{c}_{c}" if i == c else f"a_{i}_{m} - a_{i}_{c} * a_{c}_{m} / a_{c}_{c}") + f" AS a_{i}_{m}"
                     for i in range(n) for m in range(n)]
            cells += [(f"b_{c} / a_{c}_{c}" if i == c else f"b_{i} - a_{i}_{c} * b_{c} / a_{c}_{c}") + f" AS b_{i}" for i in range(n)]
            out.append(f"m_{s}_{c + 1} AS MATERIALIZED (SELECT model, {kept}, {', '.join(cells)} FROM m_{s}_{c})")
        out.append(f"t{s + 1} AS MATERIALIZED (SELECT model, " + ", ".join(f"t_{i} - b_{i} AS t_{i}" for i in range(n)) + f" FROM m_{s}_{n})")
    return out


STEPS = 8


def trained_queries() -> dict[str, str]:
    """Models of one feature, trained by Newton steps in SQL."""
    y = "CASE WHEN cand_idx = 0 THEN 1 ELSE 0 END"
    p1 = "1.0 / (1.0 + exp(-(t_0 + t_1 * score)))"
    sq = {}
    whole = [f"tr AS MATERIALIZED (SELECT 0 AS model, {y} AS y, CASE WHEN cand_idx = 0 THEN 5.0 ELSE 1.0 END::DOUBLE AS a, score AS x1 FROM all_scores)",
             "reg AS (SELECT 0 AS model, 0.0::DOUBLE AS reg)"]
    sq["train_classifier"] = scored_with(RECS, ALL_SCORES, *whole, *newton(1, 2, STEPS)) + (
        f"\nSELECT record_id, cand_idx::INTEGER AS cand_idx, round({p1}, 4) AS p1 FROM all_scores, t{STEPS}")
    grid = [f"roles AS MATERIALIZED (SELECT * FROM ({splits_random(1, 0.2, 0.2, False)}))",
            "reg AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.01::DOUBLE), (2, 0.1::DOUBLE)) v(model, reg))",
            f"tr AS MATERIALIZED (SELECT model, {y} AS y, 1.0::DOUBLE AS a, score AS x1 FROM all_scores JOIN roles USING (record_id), reg "
            "WHERE role = 'train')"]
    judged = [f"va AS (SELECT model, {y} AS y, {p1} AS p FROM all_scores JOIN roles USING (record_id), t{STEPS} WHERE role = 'val')",
              "rk AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM va)",
              "au AS (SELECT model, (sum(CASE WHEN y = 1 THEN r END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)::DOUBLE "
              "/ (count_if(y = 1)::DOUBLE * count_if(y = 0)) AS auc FROM rk GROUP BY model)"]
    sq["select_best_model"] = scored_with(RECS, ALL_SCORES, *grid, *newton(1, 2, STEPS), *judged) + (
        "\nSELECT reg AS reg_param, round(auc, 6) AS val_roc_auc FROM au JOIN reg USING (model) ORDER BY round(auc, 9) DESC, model LIMIT 1")
    folds = [f"roles AS MATERIALIZED (SELECT * FROM ({splits_random(3, 0.2, 0.2, False)}))",
             "reg AS (SELECT DISTINCT fold AS model, 0.0::DOUBLE AS reg FROM roles)",
             f"tr AS MATERIALIZED (SELECT fold AS model, {y} AS y, 1.0::DOUBLE AS a, score AS x1 FROM all_scores JOIN roles USING (record_id) "
             "WHERE role = 'train')", *newton(1, 2, STEPS),
             "fm AS (SELECT record_id, fold FROM roles WHERE role = 'test')",
             f"tested AS MATERIALIZED (SELECT fold, record_id, cand_idx, {p1} AS score FROM all_scores JOIN fm USING (record_id) "
             f"JOIN t{STEPS} ON model = fold)"]
    items_f = """items_f AS MATERIALIZED (
  SELECT o.fold, o.record_id, any_value(o.score) AS pos, count(x.score) AS n_neg, (1 + count_if(x.score > o.score))::INTEGER AS rnk,
         count_if(o.score > x.score)::INTEGER AS wins, max(x.score) AS max_neg
  FROM tested o JOIN tested x ON x.record_id = o.record_id AND x.fold = o.fold AND x.cand_idx > 0
  WHERE o.cand_idx = 0 GROUP BY o.fold, o.record_id)"""
    sq["run_folds"] = fold_metrics(", ".join([ALL_SCORES, *folds]), False, items_f, "tested s JOIN items_f f USING (record_id, fold)") + (
        "SELECT fold, metric, round(value, 4) AS value, 'ok' AS status FROM long")
    labelled = ["tr AS MATERIALIZED (SELECT 0 AS model, CASE WHEN l.toxic = 1 THEN 2 ELSE l.quality END AS y, 1.0::DOUBLE AS a, s.score AS x1 "
                "FROM all_scores s JOIN labels l ON l.doc_id = s.record_id WHERE s.cand_idx = 0)", "reg AS (SELECT 0 AS model, 0.01::DOUBLE AS reg)"]
    rows = " UNION ALL ".join(f"SELECT {c} AS class, round(t_{2 * c - 2}, 4) AS bias, round(t_{2 * c - 1}, 4) AS weight FROM t{STEPS}" for c in (1, 2))
    sq["train_multiclass"] = scored_with(RECS, ALL_SCORES, *labelled, *newton(1, 3, STEPS)) + (
        f"\nSELECT class::INTEGER AS class, bias, weight FROM (SELECT 0 AS class, 0.0 AS bias, 0.0 AS weight UNION ALL {rows})")
    return sq


def boundaries_with(*more: str) -> str:
    """CTEs that learn sentence boundaries: ``lists(kind, type, next, score)`` and the plain pieces ``sent``."""
    outside = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$'"

    def word(x):
        return f"regexp_replace(lower(regexp_replace({x}, {outside}, '', 'g')), '\\.$', '')"

    def xlog(k, x):
        return f"(CASE WHEN {k} = 0 THEN 0.0 ELSE {k} * ln(greatest({x}, 1e-12)) END)"

    def together(a, b, ab):
        p, p1, p2 = f"({b} / TN)", f"({ab} / {a})", f"(CASE WHEN TN > {a} THEN ({b} - {ab}) / greatest(TN - {a}, 1) ELSE 1.0 END)"
        rest = f"(TN - {a} - {b} + {ab})"
        same = " + ".join([xlog(ab, p), xlog(f"({a} - {ab})", f"1 - {p}"), xlog(f"({b} - {ab})", p), xlog(rest, f"1 - {p}")])
        apart = " + ".join([xlog(ab, p1), xlog(f"({a} - {ab})", f"1 - {p1}"), xlog(f"({b} - {ab})", p2), xlog(rest, f"1 - {p2}")])
        return f"-2 * (({same}) - ({apart}))"

    dots = "(length(type) - length(replace(type, '.', '')))"
    parts = [RECS, SENT.replace("sent AS (", "sent AS MATERIALIZED (").replace("regexp_replace(summary,", "regexp_replace(replace(summary, chr(1), ' '),"),
             rf"""tok AS (SELECT unnest(string_split_regex(summary, '[ \t\r\n]+')) AS token FROM recs),
tc AS MATERIALIZED (
  SELECT type, count_if(p)::DOUBLE AS c_p, count_if(NOT p)::DOUBLE AS c_n FROM (
    SELECT {word("token")} AS type, ends_with(regexp_replace(token, {outside}, '', 'g'), '.') AS p FROM tok)
  WHERE regexp_matches(type, '\p{{L}}') GROUP BY type),
tot AS (SELECT sum(c_p + c_n) AS TN, sum(c_p) AS NP FROM tc),
ends AS (SELECT regexp_extract(a, '[^ \t\r\n]+$') AS a, regexp_extract(b, '^[^ \t\r\n]+') AS b FROM (
  SELECT unnest(sentences[1:len(sentences) - 1]) AS a, unnest(sentences[2:len(sentences)]) AS b FROM sent WHERE len(sentences) > 1)),
bc AS MATERIALIZED (SELECT {word("a")} AS type, {word("b")} AS nxt, count(*)::DOUBLE AS n FROM ends WHERE ends_with(a, '.') GROUP BY ALL),
abbr AS MATERIALIZED (SELECT * FROM (
  SELECT type, -2 * (({xlog("c_p", "NP / TN")} + {xlog("c_n", "1 - NP / TN")}) - ({xlog("c_p", "0.99::DOUBLE")} + {xlog("c_n", "(1 - 0.99::DOUBLE)")}))
         * exp(-(length(type) - {dots})::DOUBLE) * ({dots} + 1) * pow((length(type) - {dots})::DOUBLE, -c_n) AS score
  FROM tc, tot WHERE c_p >= 2) WHERE score >= 0.3),
be AS (SELECT bc.* FROM bc ANTI JOIN abbr USING (type)),
starter AS MATERIALIZED (
  SELECT nxt, score FROM (
    SELECT nxt, ab, b, A, TN, {together("A", "b", "ab")} AS score
    FROM (SELECT nxt, sum(n) AS ab FROM be GROUP BY nxt) JOIN (SELECT type AS nxt, c_p + c_n AS b FROM tc) USING (nxt),
         (SELECT sum(n) AS A FROM be), tot)
  WHERE score >= 30 AND ab * TN > b * A),
colloc AS (
  SELECT type, nxt, score FROM (
    SELECT bc.type, bc.nxt, bc.n AS ab, x.c_p + x.c_n AS a, y.c_p + y.c_n AS b, TN, {together("(x.c_p + x.c_n)", "(y.c_p + y.c_n)", "bc.n")} AS score
    FROM bc JOIN tc x ON x.type = bc.type JOIN tc y ON y.type = bc.nxt, tot
    WHERE bc.nxt IN (SELECT nxt FROM starter) AND (bc.type IN (SELECT type FROM abbr) OR regexp_full_match(bc.type, '\p{{L}}')))
  WHERE score >= 7.88 AND ab * TN > a * b),
lists AS MATERIALIZED (
  SELECT 'abbreviation' AS kind, type, NULL::VARCHAR AS next, score FROM abbr
  UNION ALL SELECT 'starter', NULL, nxt, score FROM starter UNION ALL SELECT 'collocation', type, nxt, score FROM colloc)"""]
    return cte(*parts, *more)


def boundary_queries() -> dict[str, str]:
    outside = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$'"

    def word(x):
        return f"regexp_replace(lower(regexp_replace({x}, {outside}, '', 'g')), '\\.$', '')"

    cut = rf"""pc AS (SELECT record_id, unnest(range(1, len(sentences) + 1)) AS i, unnest(sentences) AS s FROM sent),
nb AS (SELECT record_id, i, s, regexp_extract(s, '[^ \t\r\n]+$') AS a,
              regexp_extract(lead(s) OVER (PARTITION BY record_id ORDER BY i), '^[^ \t\r\n]+') AS b FROM pc),
ty AS (SELECT *, {word("a")} AS wa, {word("b")} AS wb FROM nb),
jn AS (SELECT record_id, i, s, b IS NOT NULL AND ends_with(a, '.')
              AND (wa IN (SELECT type FROM abbr) OR regexp_full_match(wa, '\p{{L}}'))
              AND NOT (wb IN (SELECT nxt FROM starter) AND regexp_matches(b, '^[^\p{{L}}]*\p{{Lu}}')
                       AND NOT ((wa, wb) IN (SELECT (type, nxt) FROM colloc))) AS keep FROM ty),
done AS (SELECT record_id, string_agg(s || CASE WHEN keep THEN ' ' ELSE chr(1) END, '' ORDER BY i) AS j FROM jn GROUP BY record_id),
fin AS (SELECT r.record_id, list_filter(string_split(coalesce(j, ''), chr(1)), lambda x: x <> '') AS t FROM recs r LEFT JOIN done USING (record_id))"""
    return {"learned_boundaries": boundaries_with() + "\nSELECT kind, type, next, round(score, 6) AS score FROM lists",
            "learned_sentences": boundaries_with(cut) + "\nSELECT record_id, len(t)::INTEGER AS n_sentences, "
                                 "md5(array_to_string(t, chr(1))) AS sentences_md5 FROM fin"}


def fold_metrics(membership: str | None = None, groups: bool = True, items_f: str | None = None,
                 negatives: str = "scores s JOIN items_f f USING (record_id)") -> str:
    """Per-fold test reports as ``long(fold, metric, value)``, prefixed ``test_``.

    ``membership`` is a CTE ``fm(record_id, fold)`` naming each fold's test
    records (default: leave one source out).
    """
    items_f = items_f or """items_f AS (SELECT i.*, fm.fold FROM items i JOIN fm USING (record_id))"""
    # per-fold aggregate written directly (negatives pooled per fold)
    per = f"""per AS (
  SELECT fold,
    count(*)::BIGINT AS evaluated_items_count,
    count_if(rnk = 1)::BIGINT AS top_1_success_count,
    count_if(rnk > 1)::BIGINT AS top_1_failure_count,
    {_rd("avg(CASE WHEN rnk = 1 THEN 1.0 ELSE 0.0 END::DOUBLE)")} AS top_1_accuracy,
    {_rd("avg(1.0::DOUBLE / rnk)")} AS mean_reciprocal_rank,
    {_rd("sum(wins)::DOUBLE / nullif(sum(n_neg), 0)")} AS pair_ranking_accuracy,
    coalesce(sum(wins), 0)::BIGINT AS pair_correct_count,
    coalesce(sum(n_neg), 0)::BIGINT AS pair_total_count,
    {_rd("avg(n_neg::DOUBLE)")} AS avg_len_shuffled,
    {_rd("avg(CASE WHEN rnk = 1 THEN n_neg::DOUBLE END)")} AS avg_len_shuffled_success,
    {_rd("avg(CASE WHEN rnk > 1 THEN n_neg::DOUBLE END)")} AS avg_len_shuffled_failure,
    {_rd("avg(pos)")} AS avg_positive_score,
    {_rd("stddev_pop(pos)")} AS std_positive_score,
    {_rd("avg(CASE WHEN rnk = 1 THEN pos - max_neg END)")} AS avg_margin_victory,
    {_rd("avg(CASE WHEN rnk > 1 THEN max_neg - pos END)")} AS avg_margin_defeat,
    {", ".join(_rd(f"avg(CASE WHEN rnk <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE)") + f" AS recall_at_{k}" for k in (3, 5, 10))},
    {", ".join(_rd(f"avg(CASE WHEN rnk <= {k} THEN 1.0::DOUBLE / log2(rnk + 1) ELSE 0.0::DOUBLE END)") + f" AS ndcg_at_{k}" for k in (3, 5, 10))}
  FROM items_f GROUP BY fold),
negf AS (
  SELECT fold, {_rd("avg(s.score)")} AS avg_negative_score, {_rd("stddev_pop(s.score)")} AS std_negative_score
  FROM {negatives} WHERE s.cand_idx > 0 GROUP BY fold),
totf AS (SELECT fold, count(*)::BIGINT AS total_items_in_dataset FROM fm GROUP BY fold),
wide AS (
  SELECT t.fold, t.total_items_in_dataset, p.* EXCLUDE (fold),
         coalesce(n.avg_negative_score, 0.0) AS avg_negative_score,
         coalesce(n.std_negative_score, 0.0) AS std_negative_score
  FROM totf t LEFT JOIN per p USING (fold) LEFT JOIN negf n USING (fold))"""
    unp = "\nUNION ALL ".join(
        f"SELECT fold::INTEGER AS fold, 'test_{_reported(c)}' AS metric, coalesce({c}::DOUBLE, 0.0) AS value FROM wide"
        for c in REPORT_COLS)
    parts = ([GROUPS] if groups else []) + [membership or KEY_MEMBERSHIP, items_f, per]
    return scored_with(RECS, *parts) + ",\nlong AS (" + unp + ")\n"


SUMMARY_SELECT = f"""SELECT metric, round(avg(value), {R}) AS mean,
       round(coalesce(stddev_samp(value), 0.0), {R}) AS std, count(value)::BIGINT AS n_folds
FROM long GROUP BY metric"""


def _md5_list(expr: str) -> str:
    return f"md5(array_to_string({expr}, chr(1)))"


def all_queries() -> dict[str, str]:
    sq: dict[str, str] = {}
    sq["read_records"] = ("WITH " + RECS + "\nSELECT record_id AS doc_id, source, length(summary)::BIGINT AS n_chars, "
                          "md5(summary) AS summary_md5, 1::BIGINT AS id_rows FROM recs")
    sq["filter_nonempty"] = "SELECT count(*)::BIGINT AS n_kept FROM documents WHERE text IS NOT NULL AND text <> ''"
    base = cte(RECS, SENT, PLAN)
    sq["split_sentences"] = (base + "\nSELECT record_id, n::INTEGER AS n_sentences, "
                             "md5(array_to_string(sentences, chr(1))) AS sentences_md5 FROM plan")
    sq["sentence_count"] = base + "\nSELECT n::INTEGER AS n_sentences, count(*)::BIGINT AS n_texts FROM plan GROUP BY n"
    sq["shuffle_plan"] = (cte(RECS, SENT, PLAN) + "\nSELECT record_id, n::INTEGER AS n_sentences, want::INTEGER AS want,"
                          " method FROM plan2")
    sq["distinct_permutations"] = (shuffles_with() + "\nSELECT p.record_id, count(d.t)::BIGINT AS n_distinct "
                                   "FROM plan2 p LEFT JOIN enum_d d USING (record_id) WHERE p.method = 'enumerate' "
                                   "GROUP BY p.record_id")
    sq["sample_permutations"] = (shuffles_with() + "\nSELECT record_id, cand_idx::INTEGER AS cand_idx, "
                                 "array_to_string(t, ',') AS order_str FROM enum_r WHERE cand_idx <= want")
    sq["sample_shuffles"] = (shuffles_with() + "\nSELECT record_id, cand_idx::INTEGER AS cand_idx, "
                             "array_to_string(t, ',') AS order_str FROM samp_r WHERE cand_idx <= want")
    neg_text = """neg_text AS (
  SELECT n.record_id, n.cand_idx, array_to_string(list_transform(n.t, lambda i: p.sentences[i + 1]), ' ') AS text
  FROM negs n JOIN plan2 p USING (record_id))"""
    sq["join_sentences"] = (shuffles_with(RECS, neg_text) + "\nSELECT record_id, cand_idx::INTEGER AS cand_idx, "
                            "md5(text) AS text_md5, length(text)::BIGINT AS text_len FROM neg_text")
    sq["generate_shuffles"] = (shuffles_with() + """
SELECT p.record_id, count(n.t)::BIGINT AS n_neg,
       md5(coalesce(string_agg(array_to_string(n.t, ','), ';' ORDER BY n.cand_idx), '')) AS shuffles_md5
FROM plan2 p LEFT JOIN negs n USING (record_id) GROUP BY p.record_id""")
    cands_text = neg_text + """,
cand_text AS (
  SELECT record_id, 0 AS cand_idx, summary AS text FROM plan2
  UNION ALL SELECT record_id, cand_idx, text FROM neg_text),
nn AS (SELECT p.record_id, count(n.t) AS n_neg FROM plan2 p LEFT JOIN negs n USING (record_id) GROUP BY p.record_id)"""
    sq["labelled_pairs"] = (shuffles_with(RECS, cands_text) + """
SELECT record_id, cand_idx::INTEGER AS cand_idx, CASE WHEN cand_idx = 0 THEN 1 ELSE 0 END::INTEGER AS label,
       md5(text) AS text_md5, length(text)::BIGINT AS text_len FROM cand_text""")
    sq["ranking_candidates"] = (shuffles_with(RECS, cands_text) + """
SELECT c.record_id, c.cand_idx::INTEGER AS cand_idx, nn.n_neg::BIGINT AS n_neg, md5(c.text) AS text_md5
FROM cand_text c JOIN nn USING (record_id)""")
    sq["truncate_tokens"] = (shuffles_with(RECS, cands_text) + f""",
tok AS (SELECT record_id, cand_idx, text,
               string_split_regex(regexp_replace(text, {EDGE}, '', 'g'), '[ \\t\\r\\n]+') AS tk FROM cand_text)
SELECT record_id, cand_idx::INTEGER AS cand_idx, len(tk)::BIGINT AS n_tokens, len(tk) > 512 AS truncated,
       md5(CASE WHEN len(tk) > 512 THEN array_to_string(tk[1:512], ' ') ELSE text END) AS trunc_md5
FROM tok""")
    sq["lexical_coherence"] = (scored_with(RECS, ALL_SCORES) +
                               f"\nSELECT record_id, cand_idx::INTEGER AS cand_idx, round(score, {R}) AS score "
                               "FROM all_scores")
    sq["softmax_positive"] = (scored_with(RECS, ALL_SCORES, logits_cte("all_scores")) +
                              f"\nSELECT record_id, cand_idx::INTEGER AS cand_idx, round(p1, {R}) AS p1 FROM probs")
    sq["predict_label"] = (scored_with(RECS, ALL_SCORES, logits_cte("all_scores")) +
                           "\nSELECT record_id, cand_idx::INTEGER AS cand_idx, y::INTEGER AS label, "
                           "y_pred::INTEGER AS y_pred FROM pred")
    w0, w1 = 1.0, 5.0
    sq["weighted_cross_entropy"] = (scored_with(RECS, ALL_SCORES, logits_cte("all_scores")) + f"""
SELECT round(sum(CASE WHEN y = 1 THEN {w1} ELSE {w0} END::DOUBLE * -({log_pt()}))
             / sum(CASE WHEN y = 1 THEN {w1} ELSE {w0} END::DOUBLE), {R}) AS loss FROM probs""")
    a0, a1 = 0.25, 0.75
    focal = f"(-pow(1 - exp({log_pt()}), 2.0) * ({log_pt()}))"
    sq["focal_loss"] = (scored_with(RECS, ALL_SCORES, logits_cte("all_scores")) + f"""
SELECT round(avg(CASE WHEN y = 1 THEN {a1} ELSE {a0} END::DOUBLE * {focal}), {R}) AS loss_mean,
       round(sum(CASE WHEN y = 1 THEN {a1} ELSE {a0} END::DOUBLE * {focal}), {R}) AS loss_sum,
       round(avg(-pow(1 - exp({log_pt()}), 0.0) * ({log_pt()})), {R}) AS loss_gamma0
FROM probs""")
    sq["rank_of_original"] = items_sql(
        f"SELECT record_id, rnk AS rank, n_neg::BIGINT AS n_neg, wins::BIGINT AS wins, round(pos, {R}) AS pos, "
        f"round(max_neg, {R}) AS max_neg FROM items")
    sq["rankable"] = items_sql("SELECT record_id, n_neg::BIGINT AS n_neg FROM items")
    sq["item_pair_score"] = items_sql(
        f"SELECT p.record_id, round(CASE WHEN i.n_neg > 0 THEN i.wins::DOUBLE / i.n_neg ELSE -1.0 END, {R}) "
        "AS pair_score FROM plan2 p LEFT JOIN items i USING (record_id)")
    sq["candidate_count_ok"] = (scored_with(RECS, ALL_SCORES) +
                                "\nSELECT record_id, count(*)::BIGINT AS n_scores FROM all_scores GROUP BY record_id")
    sq["top1"] = report(["top_1_success_count", "top_1_accuracy"])
    sq["pairwise_accuracy"] = report(["pair_correct_count", "pair_total_count", "pair_ranking_accuracy"])
    sq["mean_reciprocal_rank"] = report(["mean_reciprocal_rank"])
    sq["recall_at_k"] = report(["recall_at_3", "recall_at_5", "recall_at_10"])
    sq["ndcg_at_k"] = report(["ndcg_at_3", "ndcg_at_5", "ndcg_at_10"])
    sq["shuffle_count_stats"] = report(["avg_len_shuffled", "avg_len_shuffled_success", "avg_len_shuffled_failure"])
    sq["top1_counts"] = report(["top_1_success_count", "top_1_failure_count"])
    sq["margins"] = report(["avg_margin_victory", "avg_margin_defeat"])
    sq["positive_score_stats"] = report(["avg_positive_score", "std_positive_score"])
    sq["negative_score_stats"] = report(["avg_negative_score", "std_negative_score"])
    sq["item_counts"] = report(["total_items_in_dataset", "evaluated_items_count", "pair_total_count"])
    sq["ranking_report"] = report()
    short = "record_id IN (SELECT record_id FROM plan2 WHERE n < 2)"
    sq["empty_result"] = scored_with() + "\n" + report_select(
        total="(SELECT count(*) FROM plan2 WHERE n < 2)", where=short)
    sq["report_rows"] = report_rows()
    sq["accuracy"] = classification(["accuracy"])
    sq["f1"] = classification(["f1"])
    sq["roc_auc"] = classification(["roc_auc"])
    sq["average_precision"] = classification(["pr_auc"])
    sq["classification_report"] = classification()
    quality = f"""qual AS (
  SELECT p.record_id, 0 AS cand_idx, coalesce(s.score, 0.0::DOUBLE) AS score, l.quality AS y
  FROM plan2 p JOIN labels l ON l.doc_id = p.record_id
  LEFT JOIN scores s ON s.record_id = p.record_id AND s.cand_idx = 0),
lgq AS (SELECT record_id, cand_idx, y, 0.0::DOUBLE AS l0, score - {THRESHOLD}::DOUBLE AS l1 FROM qual),
lgq2 AS (SELECT *, greatest(l0, l1) AS m FROM lgq),
pred AS (
  SELECT *, exp(l0 - m) / (exp(l0 - m) + exp(l1 - m)) AS p0, exp(l1 - m) / (exp(l0 - m) + exp(l1 - m)) AS p1,
         CASE WHEN exp(l1 - m) / (exp(l0 - m) + exp(l1 - m)) > exp(l0 - m) / (exp(l0 - m) + exp(l1 - m))
              THEN 1 ELSE 0 END AS y_pred
  FROM lgq2)"""
    sq["quality_classification"] = scored_with(RECS, quality, CLASS_AGG) + "\n" + CLASS_SELECT
    sq["split_exact"] = ("WITH " + RECS + f""",
k AS (SELECT record_id, ('0x' || substr(md5(concat_ws('|', {SEED}, 'split', 1, 'test', record_id)), 1, 15))::BIGINT AS kt
      FROM recs),
r AS (SELECT record_id, row_number() OVER (ORDER BY kt, record_id) AS rn FROM k)
SELECT record_id, rn <= floor((SELECT count(*) FROM recs)::DOUBLE * 0.29::DOUBLE) AS held FROM r""")
    sq["random_holdout"] = splits_random(3, 0.2, 0.2, False)
    sq["no_test_split"] = splits_random(2, 0.2, 0.2, True)
    sq["split_sizes"] = ("SELECT fold, role, count(*)::BIGINT AS n FROM (" + splits_random(3, 0.2, 0.2, False)
                         + ") GROUP BY fold, role")
    sq["distinct_groups"] = cte(RECS, GROUPS) + '\nSELECT "group", first_seen, position FROM grp2'
    sq["pick_val_group"] = cte(RECS, GROUPS) + "\nSELECT fold::INTEGER AS fold, test_group, val_group FROM folds_g"
    sq["leave_one_group_out"] = group_roles()
    sq["prefix_metrics"] = fold_metrics() + "SELECT fold, metric, value FROM long"
    sq["cv_summary"] = fold_metrics() + SUMMARY_SELECT
    sq["cv_summary_random_folds"] = fold_metrics(random_membership(3, 0.2), groups=False) + SUMMARY_SELECT
    # the stand-in classifier: share of full stops in the text as the model sees it
    stand_in = cands_text + f""",
tok AS (SELECT record_id, cand_idx, text,
               string_split_regex(regexp_replace(text, {EDGE}, '', 'g'), '[ \\t\\r\\n]+') AS tk FROM cand_text),
cut AS (SELECT record_id, cand_idx,
               CASE WHEN len(tk) > 512 THEN array_to_string(tk[1:512], ' ') ELSE text END AS seen FROM tok),
lgt AS (SELECT record_id, cand_idx,
               (length(seen) - length(replace(seen, '.', '')))::DOUBLE / greatest(length(seen), 1)::DOUBLE
                 * 10.0::DOUBLE - 0.1::DOUBLE AS l1 FROM cut),
scores AS MATERIALIZED (
  SELECT record_id, cand_idx,
         exp(l1 - greatest(l1, 0.0::DOUBLE)) / (exp(0.0::DOUBLE - greatest(l1, 0.0::DOUBLE)) + exp(l1 - greatest(l1, 0.0::DOUBLE)))
           AS score FROM lgt),
items AS MATERIALIZED (
  SELECT o.record_id, any_value(o.score) AS pos, count(x.score) AS n_neg,
         (1 + count_if(x.score > o.score))::INTEGER AS rnk,
         count_if(o.score > x.score)::INTEGER AS wins, max(x.score) AS max_neg
  FROM scores o JOIN scores x ON x.record_id = o.record_id AND x.cand_idx > 0
  WHERE o.cand_idx = 0 GROUP BY o.record_id)"""
    sq["score_candidates"] = (shuffles_with(RECS, stand_in) +
                              f"\nSELECT record_id, cand_idx::INTEGER AS cand_idx, round(score, {R}) AS score FROM scores")
    sq["model_report"] = shuffles_with(RECS, stand_in) + "\n" + report_select()
    sq["jsonl_records"] = ("WITH " + RECS + "\nSELECT source, count(*)::BIGINT AS n, count(*)::BIGINT AS n_ids, "
                           "count(DISTINCT summary)::BIGINT AS n_texts FROM recs GROUP BY source")
    sq["flatten_record"] = "SELECT doc_id, source, md5(text) AS summary_md5 FROM documents"
    sq["read_eval_csv"] = (
        "WITH lined AS (SELECT doc_id, '\"' || replace(text, '. ', '.' || chr(10)) || '\",' || chr(10) AS t FROM documents WHERE text <> '')\n"
        "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5, 1::BIGINT AS id_rows FROM lined")
    sq["eval_csv_report"] = scored_with(BENCH_RECS) + "\n" + report_select()
    sq["eval_csv_items"] = scored_with(BENCH_RECS) + (
        f"\nSELECT p.record_id AS item_id, round(CASE WHEN i.n_neg > 0 THEN i.wins::DOUBLE / i.n_neg ELSE -1.0 END,"
        f" {R}) AS pair_score FROM plan2 p LEFT JOIN items i USING (record_id)")
    return sq | trained_queries() | boundary_queries()
