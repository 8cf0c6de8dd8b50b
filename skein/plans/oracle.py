"""The queries of ``skein.plans.queries`` in SQL, written from the definitions."""

from __future__ import annotations

from skein.config import SearchConfig

C = SearchConfig()
_W, _P, _B = C.w, C.parts, C.bits
CHAIN = f"""
WITH raw AS (SELECT vec_id, embedding, label FROM embeddings WHERE len(embedding) = {C.dim}),
e AS (
  SELECT vec_id, CAST(unnest(range(0, {C.dim})) AS INTEGER) AS j,
         unnest(list_transform(embedding, lambda y: greatest(-127, least(127, CAST(trunc(CAST(y AS FLOAT) * CAST({C.factor} AS FLOAT)) AS INTEGER))))) AS x FROM raw),
med AS (SELECT j, quantile_cont(x, 0.5) AS m FROM e GROUP BY j),
bin AS (SELECT vec_id, j, CASE WHEN x < m THEN -127 ELSE 127 END AS x FROM e JOIN med USING (j)),
pc AS (SELECT CAST(vec_id AS INTEGER) AS p, j, x AS c FROM bin WHERE vec_id < {_W}),
d AS MATERIALIZED (SELECT vec_id, p, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM e JOIN pc USING (j) GROUP BY vec_id, p),
r AS (SELECT p, quantile_cont(d, 0.5) AS r FROM d GROUP BY p),
s AS MATERIALIZED (SELECT vec_id, CAST(sum(CASE WHEN d < r THEN CAST(1 AS BIGINT) << p ELSE 0 END) AS BIGINT) AS sketch FROM d JOIN r USING (p) GROUP BY vec_id),
b AS (SELECT sketch, count(*) AS n FROM s GROUP BY sketch),
near AS (SELECT vec_id AS qid, p, CASE WHEN d < r THEN 1 ELSE 0 END AS bit, sqrt(CAST(d AS DOUBLE)) - sqrt(r) AS near FROM d JOIN r USING (p) WHERE vec_id < {C.nq}),
ctx AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY bd, p) - 1 AS INTEGER) AS rank
  FROM (SELECT qid, p, CAST(trunc(abs(near)) AS INTEGER) AS bd FROM near)),
pr AS MATERIALIZED (
  SELECT c.qid, b.sketch, b.n,
    CAST(sum(CASE WHEN f THEN bd ELSE 0 END) AS BIGINT) AS prio, CAST(max(CASE WHEN f THEN bd ELSE 0 END) AS BIGINT) AS pinf,
    CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS ham, CAST(sum(CASE WHEN f THEN CAST(1 AS BIGINT) << rank ELSE 0 END) AS BIGINT) AS pt,
    CAST(sum(CASE WHEN f AND rank >= 3 THEN bd ELSE 0 END) AS BIGINT) AS high
  FROM (SELECT c.*, q.sketch AS qs, b.sketch AS bs, b.n AS bn, (xor(b.sketch, q.sketch) >> c.p) & 1 = 1 AS f FROM ctx c JOIN s q ON q.vec_id = c.qid CROSS JOIN b) c
  JOIN b ON b.sketch = c.bs GROUP BY c.qid, b.sketch, b.n),
gr AS (SELECT *, {'xor(' * (_W - 1)}pt{''.join(f', pt >> {k})' for k in range(1, _W))} AS g FROM pr),
mem AS (SELECT gr.*, s.vec_id FROM gr JOIN s USING (sketch)),
sm AS MATERIALIZED (
  SELECT e.vec_id, p.p, CAST(trunc(sqrt(CAST(sum((e.x - p.x) * (e.x - p.x)) AS DOUBLE))) AS BIGINT) AS s
  FROM e JOIN (SELECT CAST(vec_id - {_W} AS INTEGER) AS p, j, x FROM bin WHERE vec_id BETWEEN {_W} AND {_W + _P - 1} AND j // {C.dim // _P} = vec_id - {_W}) p USING (j) GROUP BY e.vec_id, p.p),
av AS (SELECT CAST(sum(s) AS DOUBLE) / count(*) AS a, CAST(sum(s * s) AS DOUBLE) / count(*) AS q FROM sm WHERE vec_id < {C.nq}),
qp AS (SELECT a, sd, 2 * {C.q_range}::DOUBLE * sd / {C.codes} AS slice, a - {C.q_range}::DOUBLE * sd AS off FROM (SELECT a, sqrt(greatest(q - a * a, 0)) AS sd FROM av)),
co AS MATERIALIZED (SELECT vec_id, p, CAST(least({C.codes - 1}, trunc(greatest(CAST(s AS DOUBLE) - off, 0) / slice)) AS INTEGER) AS code FROM sm, qp),
ta AS MATERIALIZED (
  SELECT vec_id AS qid, p, CAST(code AS INTEGER) AS code, CAST(trunc(pow(abs(trunc(CAST(s AS DOUBLE) - ((code + 0.5::DOUBLE) * slice + off))), {C.p2}::DOUBLE)) AS BIGINT) AS t
  FROM sm, qp, range(0, {C.codes}) k(code) WHERE vec_id < {C.nq}),
a AS MATERIALIZED (SELECT q.vec_id AS qid, e.vec_id, CAST(sum((q.x - e.x) * (q.x - e.x)) AS BIGINT) AS dist, CAST(sum(abs(q.x - e.x)) AS BIGINT) AS l1 FROM e q JOIN e USING (j) WHERE q.vec_id < {C.nq} GROUP BY q.vec_id, e.vec_id),
ex AS MATERIALIZED (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, dist FROM a)),
d2 AS MATERIALIZED (SELECT qid, vec_id, CAST(sum(t) AS BIGINT) AS d2, max(t) AS t FROM co JOIN ta USING (p, code) GROUP BY qid, vec_id),
"""


def _budget(nc1, order="prio"):
    return f"""SELECT pr.* FROM pr JOIN (SELECT qid, {order}, sum(m) OVER (PARTITION BY qid ORDER BY {order}) - m AS before FROM (SELECT qid, {order}, sum(n) AS m FROM pr GROUP BY qid, {order})) USING (qid, {order}) WHERE before < {nc1}"""


def _second(nc1, nc2, order="prio"):
    return f"""SELECT * FROM (SELECT d2.qid, CAST(row_number() OVER (PARTITION BY d2.qid ORDER BY d2.d2, d2.vec_id) AS INTEGER) AS rank, d2.vec_id, d2.d2 FROM ({_budget(nc1, order)}) x JOIN s USING (sketch) JOIN d2 ON d2.qid = x.qid AND d2.vec_id = s.vec_id) WHERE rank <= {nc2}"""


def _rerank(nc1, nc2):
    return f"""SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, dist FROM a JOIN ({_second(nc1, nc2)}) y USING (qid, vec_id)) WHERE rank <= {C.k}"""


def _listed(order, rows="mem", n=C.nc1, columns="qid, vec_id"):
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rn FROM {rows}) WHERE rn <= {n}"


_SEARCH = f"se AS MATERIALIZED ({_rerank(C.nc1, C.nc2)})\n"
_POS = "SELECT vec_id, sketch, CAST(row_number() OVER (ORDER BY sketch, vec_id) - 1 AS BIGINT) AS pos FROM s"
_CTX = "SELECT qid, sketch AS qs, p, bd, rank FROM {} JOIN s ON s.vec_id = qid"
_KNN = f"(SELECT * FROM ex WHERE rank <= {C.k})"
_PAIRS = f"FROM e q JOIN e USING (j) WHERE q.vec_id < {C.nq}"
_PROJ = f"FROM sm q JOIN sm USING (p) WHERE q.vec_id < {C.nq}"
_TRIALS = [(0, 60, 30), (1, 100, 30), (2, 200, 40)]


def _recall(k, found):
    return f"SELECT count(f.vec_id) * 100.0::DOUBLE / count(*) AS recall FROM (SELECT * FROM ex WHERE rank <= {k}) t LEFT JOIN ({found}) f USING (qid, vec_id)"


FINAL = {
    "scan_vectors": "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM raw",
    "slice_range": "SELECT vec_id, label FROM raw WHERE vec_id BETWEEN 100 AND 149",
    "point_get": "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x0 FROM raw WHERE vec_id = 7",
    "union_files": "SELECT vec_id AS gid, label FROM raw UNION ALL SELECT vec_id + 1000000, label FROM raw",
    "gather_by_id": f"SELECT vec_id, label FROM raw WHERE vec_id IN (SELECT vec_id FROM ({_second(C.nc1, C.nc2)}))",
    "params": "SELECT CAST(t AS INTEGER) AS trial, CAST(x AS INTEGER) AS nc1, CAST(y AS INTEGER) AS nc2 FROM (VALUES " + ", ".join(map(str, _TRIALS)) + ") v(t, x, y)",
    "ground_truth": f"SELECT qid, rank, vec_id, dist FROM {_KNN}",
    "result_wide": "SELECT qid, string_agg(CAST(vec_id + 1 AS VARCHAR), ',' ORDER BY rank) AS ids FROM se GROUP BY qid",
    "quantize": "SELECT vec_id, j, x FROM e",
    "overflow_count": "SELECT CAST(sum(len(list_filter(embedding, lambda y: abs(trunc(CAST(y AS FLOAT) * CAST(500 AS FLOAT))) > 127))) AS BIGINT) AS overflow FROM raw",
    "rotate": f"SELECT vec_id, CAST(k AS INTEGER) AS j, x FROM e JOIN range(0, {C.dim}) t(k) ON e.j = (k * 5 + 3) % {C.dim}",
    "binarize": "SELECT vec_id, j, x FROM bin",
    "ternarize": "SELECT vec_id, j, CASE WHEN x < m - sd * 0.5::DOUBLE THEN -127 WHEN x > m + sd * 0.5::DOUBLE THEN 127 ELSE 0 END AS x FROM e JOIN (SELECT j, a / n AS m, sqrt(b / n - (a / n) * (a / n)) AS sd FROM (SELECT j, CAST(sum(x) AS DOUBLE) AS a, CAST(sum(x * x) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY j)) USING (j)",
    "dist_l1": "SELECT qid, vec_id, l1 AS dist FROM a",
    "dist_l2sq": "SELECT qid, vec_id, dist FROM a",
    "dist_l2_root": f"SELECT q.vec_id AS qid, e.vec_id, CAST(sum(CAST(q.x * q.x - e.x * e.x AS BIGINT) * (q.x * q.x - e.x * e.x)) AS BIGINT) AS dist {_PAIRS} GROUP BY ALL",
    "proj_dist_folded": "SELECT qid, vec_id, d2 FROM d2",
    "result_dist": "SELECT qid, 'secret, secret, ' || string_agg((vec_id + 1) || ', ' || dist, ',' ORDER BY rank) AS line FROM se GROUP BY qid",
    "result_eval": "SELECT se.qid, any_value(x.vec_id || ',' || x.dist) || ',' || string_agg(se.vec_id || ', ' || se.dist, ',' ORDER BY se.rank) AS line FROM se JOIN ex x ON x.qid = se.qid AND x.rank = 1 GROUP BY se.qid",
    "result_nearest": "SELECT qid, qid || ',' || vec_id || ',' || dist AS line FROM se WHERE rank = 1",
    "check_enum_hamming": "SELECT qid, buckets, vectors FROM (SELECT qid, sketch, CAST(row_number() OVER w AS INTEGER) AS buckets, CAST(sum(n) OVER w AS BIGINT) AS vectors FROM pr WINDOW w AS (PARTITION BY qid ORDER BY ham, pt)) JOIN (SELECT qid, s.sketch FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM ex WHERE rank <= 2 AND vec_id <> qid) t JOIN s USING (vec_id) WHERE k = 1) g USING (qid, sketch)",
    "enum_intervals": f"SELECT qid, min(pos) AS first, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(pos + n) OVER (PARTITION BY qid ORDER BY pos) = pos THEN 0 ELSE 1 END AS new FROM (SELECT x.qid, x.n, z.pos FROM ({_budget(C.nc1)}) x JOIN (SELECT sketch, CAST(sum(n) OVER (ORDER BY sketch) - n AS BIGINT) AS pos FROM b) z USING (sketch)))) GROUP BY qid, run",
    "query_cost": f"SELECT qid, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS cost FROM ({_budget(C.nc1)}) GROUP BY qid",
    "dist_l2_part": f"SELECT q.vec_id AS qid, e.vec_id, CAST(sum((q.x - e.x) * (q.x - e.x)) AS BIGINT) AS dist {_PAIRS} AND j BETWEEN 16 AND 31 GROUP BY q.vec_id, e.vec_id",
    "dist_l2_sparse": f"SELECT q.vec_id AS qid, e.vec_id, CAST(sum((q.x - e.x) * (q.x - e.x)) AS BIGINT) AS dist {_PAIRS} AND j % 7 = 0 GROUP BY q.vec_id, e.vec_id",
    "dist_pivot": "SELECT vec_id, p, d AS dist FROM d",
    "sketch": "SELECT vec_id, sketch FROM s",
    "sketch_1bit": "SELECT vec_id, CASE WHEN d < r THEN 1 ELSE 0 END AS bit FROM d JOIN r USING (p) WHERE p = 3",
    "query_ctx": _CTX.format("ctx"),
    "query_ctx_p": _CTX.format("(SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY bd, p) - 1 AS INTEGER) AS rank FROM (SELECT qid, p, CAST(trunc(pow(abs(near), 0.75::DOUBLE)) AS INTEGER) AS bd FROM near))"),
    "bd_ave01": "SELECT p, round(avg(near) FILTER (WHERE bit = 1), 6) AS inside, round(avg(near) FILTER (WHERE bit = 0), 6) AS outside FROM near GROUP BY p",
    "bd_sd": "SELECT qid, p, round(pow(abs(near) + sd, 2) - pow(abs(abs(near) - sd), 2), 4) AS bd_plus FROM near JOIN (SELECT p, stddev_pop(near) AS sd FROM near GROUP BY p) USING (p)",
    "bd_plus": "SELECT qid, p, round(abs(near) + greatest(0, coalesce(abs(near - m) - 1.2::DOUBLE * sd, 0)), 4) AS bd FROM near LEFT JOIN (SELECT p, 1 - bit AS bit, avg(near) AS m, stddev_pop(near) AS sd FROM near GROUP BY p, bit) USING (p, bit)",
    "priority_d1": "SELECT qid, sketch, prio FROM pr",
    "priority_inf": "SELECT qid, sketch, pinf FROM pr",
    "hamming": "SELECT qid, sketch, ham FROM pr",
    "smap": "SELECT vec_id, p, s FROM sm",
    "qsmap_params": "SELECT round(a, 9) AS avg, round(sd, 9) AS sd, round(slice, 9) AS slice, round(off, 9) AS off FROM qp",
    "qsmap": "SELECT vec_id, p, code FROM co",
    "qsmap_mixed": f"SELECT vec_id, p, CAST(least(b - 1, trunc(greatest(CAST(s AS DOUBLE) - off, 0) / (2 * {C.q_range}::DOUBLE * sd / b))) AS INTEGER) AS code FROM (SELECT *, CASE WHEN p % 3 = 2 THEN 4 ELSE 8 END AS b FROM sm, qp)",
    "pack_codes": f"SELECT vec_id, CAST(p // {8 // _B} AS INTEGER) AS i, CAST(sum(code << ({_B} * ({8 // _B - 1} - p % {8 // _B}))) AS INTEGER) AS byte, true AS same FROM co GROUP BY vec_id, p // {8 // _B}",
    "dist_table": "SELECT qid, p, code, t FROM ta",
    "proj_dist_l1": f"SELECT q.vec_id AS qid, sm.vec_id, CAST(sum(abs(q.s - sm.s)) AS BIGINT) AS dist {_PROJ} GROUP BY q.vec_id, sm.vec_id",
    "proj_dist_l2": f"SELECT q.vec_id AS qid, sm.vec_id, CAST(sum((q.s - sm.s) * (q.s - sm.s)) AS BIGINT) AS dist {_PROJ} GROUP BY q.vec_id, sm.vec_id",
    "proj_dist_l2max": f"SELECT qid, vec_id, CAST(sum(m) AS BIGINT) AS dist FROM (SELECT q.vec_id AS qid, sm.vec_id, p // 4 AS g, max((q.s - sm.s) * (q.s - sm.s)) AS m {_PROJ} GROUP BY q.vec_id, sm.vec_id, p // 4) GROUP BY qid, vec_id",
    "proj_dist_lp": f"SELECT q.vec_id AS qid, sm.vec_id, CAST(sum(CAST(trunc(pow(abs(q.s - sm.s), 1.5::DOUBLE)) AS BIGINT)) AS BIGINT) AS dist {_PROJ} GROUP BY q.vec_id, sm.vec_id",
    "proj_dist_table": "SELECT qid, vec_id, d2 FROM d2",
    "proj_dist_packed": "SELECT qid, vec_id, d2 FROM d2",
    "proj_dist_inf": "SELECT qid, vec_id, t AS d2 FROM d2",
    "bit_ops": "SELECT vec_id, CAST(bit_count(sketch) AS INTEGER) AS ones, CASE WHEN sketch = 0 THEN -1 ELSE CAST(log2(sketch & -sketch) AS INTEGER) END AS lsb, CASE WHEN sketch = 0 THEN -1 ELSE CAST(floor(log2(sketch)) AS INTEGER) END AS msb, CASE WHEN sketch = 0 THEN 0 ELSE (sketch + (sketch & -sketch)) | ((xor(sketch, sketch + (sketch & -sketch)) // (sketch & -sketch)) >> 2) END AS next FROM s",
    "build_sketches": "SELECT sketch, vec_id FROM s",
    "sort_by_sketch": "SELECT sketch, vec_id FROM s ORDER BY sketch, vec_id",
    "bucket_counts": "SELECT sketch, n FROM b",
    "bucket_csr": "SELECT sketch, n, CAST(sum(n) OVER (ORDER BY sketch) - n AS BIGINT) AS pos FROM b",
    "reverse_idx": f"SELECT vec_id, pos FROM ({_POS})",
    "bit_stats": f"SELECT CAST(k AS INTEGER) AS j, CAST(sum((sketch >> k) & 1) AS BIGINT) AS n FROM s, range(0, {_W}) t(k) GROUP BY k",
    "permute_rows": f"SELECT pos, vec_id, x AS x0 FROM ({_POS}) JOIN e USING (vec_id) WHERE j = 0",
    "build_qsmap": "SELECT vec_id, string_agg(CAST(code AS VARCHAR), '' ORDER BY p) AS codes FROM co GROUP BY vec_id",
    "make_pivots": "SELECT p, j, c FROM pc",
    "filter_seq_topk": _listed("prio, vec_id"),
    "filter_seq_select": _listed("prio, vec_id", columns="qid, vec_id, prio"),
    "enum_hamming": _listed("ham, pt, vec_id"),
    "enum_conjunctive": _listed("bit_count(pt >> 5), pt >> 5, bit_count(pt & 31), pt & 31, vec_id"),
    "enum_priority": _listed("prio, sketch, vec_id"),
    "enum_c2n": f"SELECT qid, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS vectors FROM ({_budget(C.nc1)}) GROUP BY qid",
    "filter_budget": f"SELECT qid, sketch, prio, n FROM ({_budget(C.nc1)})",
    "filter_block": f"SELECT qid, sketch, n FROM ({_budget(C.nc1, 'high')})",
    "cut_priority": f"SELECT qid, max(prio) AS prio FROM ({_budget(C.nc1)}) GROUP BY qid",
    "enum_sketches": _listed("prio, sketch", f"(SELECT qid, z AS sketch, CAST(sum(CASE WHEN (xor(z, s.sketch) >> p) & 1 = 1 THEN bd ELSE 0 END) AS BIGINT) AS prio FROM ctx JOIN s ON s.vec_id = qid, range(0, {1 << _W}) t(z) GROUP BY qid, z)", f"(SELECT CAST(floor({C.nc1} / (count(*) / {1 << _W}.0)) AS BIGINT) FROM s)", "qid, sketch, prio"),
    "enum_inf": _listed("g, vec_id"),
    "enum_inf_select": _listed("prio, vec_id", f"({_listed('g, vec_id', n=2 * C.nc1, columns='*')})").replace("SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prio", "SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY qid ORDER BY prio"),
    "enum_hamming_select": _listed("prio, sketch, vec_id", f"(SELECT h.*, s.vec_id FROM ({_listed('ham, pt', 'pr', f'(SELECT CAST(floor(2.0 * floor({C.nc1} / avg(n))) AS BIGINT) FROM b)', 'qid, sketch, prio')}) h JOIN s USING (sketch))"),
    "check_enum": "SELECT qid, buckets, vectors FROM (SELECT qid, sketch, CAST(row_number() OVER w AS INTEGER) AS buckets, CAST(sum(n) OVER w AS BIGINT) AS vectors FROM pr WINDOW w AS (PARTITION BY qid ORDER BY prio, sketch)) JOIN (SELECT qid, s.sketch FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM ex WHERE rank <= 2 AND vec_id <> qid) t JOIN s USING (vec_id) WHERE k = 1) g USING (qid, sketch)",
    "double_filter": _second(C.nc1, C.nc2),
    "alternating_filter": _second(C.nc1, C.nc2, "high"),
    "rerank_knn": "SELECT * FROM se",
    "rerank_nn": "SELECT qid, vec_id, dist FROM se WHERE rank = 1",
    "exact_knn": f"SELECT qid, rank, vec_id, dist FROM {_KNN}",
    "topk_answers": f"SELECT qid, rank, vec_id FROM {_KNN}",
    "select_k": "SELECT qid, vec_id, dist FROM ex WHERE rank <= 25",
    "sort_answers": "SELECT qid, vec_id, dist FROM a ORDER BY qid, dist, vec_id",
    "select_k_ties": "SELECT qid, vec_id, prio FROM (SELECT *, rank() OVER (PARTITION BY qid ORDER BY prio) AS k FROM mem) WHERE k <= 50",
    "threshold_k": "SELECT qid, min(prio) AS bound FROM (SELECT *, rank() OVER (PARTITION BY qid ORDER BY prio) AS k FROM mem) WHERE k > 50 GROUP BY qid",
    "select_weighted": "SELECT qid, sketch, n FROM (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY prio, sketch) AS cum FROM pr) WHERE cum - n < 80",
    "recall_at_1": _recall(1, "SELECT * FROM se WHERE rank = 1"),
    "recall_at_k": _recall(C.k, "SELECT * FROM se"),
    "recall_by_dist": f"SELECT qid, count(*) FILTER (WHERE dist <= far) AS hits FROM se JOIN (SELECT qid, max(dist) AS far FROM {_KNN} GROUP BY qid) USING (qid) GROUP BY qid",
    "candidate_hit": f"SELECT qid, count(*) AS hits FROM {_KNN} JOIN s USING (vec_id) JOIN ({_budget(C.nc1)}) x USING (qid, sketch) GROUP BY qid",
    "candidate_miss": f"SELECT k.qid, k.vec_id FROM {_KNN} k JOIN s USING (vec_id) ANTI JOIN ({_budget(C.nc1)}) x ON x.qid = k.qid AND x.sketch = s.sketch",
    "latency_stats": f"SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS stdev, min(c) AS least, max(c) AS most FROM (SELECT CAST(sum(n) AS DOUBLE) AS c FROM ({_budget(C.nc1)}) GROUP BY qid)",
    "grid_eval": " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS trial, CAST({x} AS INTEGER) AS nc1, CAST({y} AS INTEGER) AS nc2, recall FROM ({_recall(C.k, _rerank(x, y))})" for t, x, y in _TRIALS),
    "summary": f"SELECT CAST({_W} AS INTEGER) AS width, CAST({_B} AS INTEGER) AS q_bit, CAST({C.nc1} AS INTEGER) AS nc1, CAST({C.nc2} AS INTEGER) AS nc2, t.*, u.recall AS recall_1, v.recall AS recall_k, l.* FROM (SELECT count(DISTINCT qid) AS queries, count(*) AS answers, CAST(sum(dist) AS BIGINT) AS dist FROM se) t, ({_recall(1, 'SELECT * FROM se WHERE rank = 1')}) u, ({_recall(C.k, 'SELECT * FROM se')}) v, (SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS stdev, min(c) AS least, max(c) AS most FROM (SELECT CAST(sum(n) AS DOUBLE) AS c FROM ({_budget(C.nc1)}) GROUP BY qid)) l",
    "normalize_dist": f"SELECT qid, rank, round(sqrt(CAST(dist AS DOUBLE)) / {C.factor}::DOUBLE, 9) AS dist FROM se",
}


def sql() -> dict[str, str]:
    return {name: CHAIN + _SEARCH + final for name, final in FINAL.items()}
