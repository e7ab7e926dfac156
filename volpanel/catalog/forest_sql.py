"""Boosted trees as one recursive DuckDB statement: a step is a tree, grown level by level for all folds at once.

Residuals are integers, so both sides of a comparison sum to the same digits. The state is a row per training and
test row (its residual) and a row per fold and epoch (its training loss, under a negative id).
"""

from volpanel import config as C
from volpanel.catalog.sql import part, with_parts
from volpanel.operators import boosting as bo

K = "series_id, horizon, test_year"


def _draw(item: str, tree: str, share: str) -> str:
    a = f"(({item}) * 7919 + ({tree}) * 104729 + 17) % {bo.PRIME}"
    for _ in range(3):
        a = f"(({a}) * {bo.FACTOR} + ({item})) % {bo.PRIME}"
    return f"(({a}) % 1000 < {share})"


def _tier(field: str) -> str:
    *above, last = C.TIERS
    return "CASE " + " ".join(f"WHEN n / horizon >= {least} THEN {p[field]}" for least, _, p in above) + f" ELSE {last[2][field]} END"


def forest_parts(tag: str, train: str, test: str, xs, label: str = "y") -> None:
    """Register the rows, thresholds and codes of one job; ``train`` and ``test`` are parts with a row per fold."""
    units = ", ".join(f"floor({x} * 1e8 + 0.5)::BIGINT" for x in xs)
    part(f"fx_{tag}", " UNION ALL ".join(f"SELECT {K}, row_no, {inside} AS tr, floor({label} * 1e9 + 0.5)::BIGINT AS y, [{units}] AS x FROM {source}"
                                         for source, inside in ((train, "true"), (test, "false"))), train, test)
    part(f"fc_{tag}", f"""SELECT {K}, j, [l[(k * len(l)) // {bo.BINS} + 1] FOR k IN range(1, {bo.BINS})] AS cuts FROM (
SELECT {K}, j, list(v ORDER BY v) AS l FROM (SELECT {K}, unnest(range(0, {len(xs)})) AS j, unnest(x) AS v FROM fx_{tag} WHERE tr) GROUP BY ALL)""", f"fx_{tag}")
    part(f"fk_{tag}", f"""SELECT *, {_tier('trees')} AS trees, {_tier('depth')} AS depth, {_tier('min_rows')} AS min_rows, row_number() OVER (ORDER BY {K}) AS cell
FROM (SELECT {K}, count(*) AS n, floor(sum(y)::DOUBLE / count(*) + 0.5)::BIGINT AS base FROM fx_{tag} WHERE tr GROUP BY ALL)""", f"fx_{tag}")
    part(f"fr_{tag}", f"""SELECT row_number() OVER (ORDER BY cell, row_no, tr) AS rid, * FROM (
SELECT cell, row_no, tr, any_value(y) AS y, any_value(y) - any_value(base) AS r0, list(c ORDER BY j) AS codes FROM (
SELECT cell, base, a.row_no, tr, y, a.j, len(list_filter(cuts, lambda e: e <= v)) AS c
FROM (SELECT {K}, row_no, tr, y, unnest(range(0, {len(xs)})) AS j, unnest(x) AS v FROM fx_{tag}) a JOIN fc_{tag} USING ({K}, j) JOIN fk_{tag} USING ({K}))
GROUP BY cell, row_no, tr)""", f"fx_{tag}", f"fc_{tag}", f"fk_{tag}")


def _level(d: int, width: int, cells: str) -> str:
    before = "w" if d == 1 else f"m{d - 1}"
    return f"""h{d} AS (SELECT cell, node, j, c, sum(r) AS g, count(*) AS n FROM (SELECT cell, t, node, r, unnest(range(0, {width})) AS j, unnest(codes) AS c
  FROM {before} WHERE smp AND depth >= {d} AND node >= {2 ** (d - 1)}) WHERE {_draw('1000003 + j', 't', bo.SHARE)} GROUP BY ALL),
a{d} AS (SELECT *, sum(g) OVER l AS gl, sum(n) OVER l AS nl, sum(g) OVER a AS gt, sum(n) OVER a AS nt FROM h{d}
  WINDOW l AS (PARTITION BY cell, node, j ORDER BY c), a AS (PARTITION BY cell, node, j)),
s{d} AS (SELECT cell, node, arg_max(struct_pack(j := j, c := c), struct_pack(gain := gain, j := -j, c := -c)) AS best FROM (
  SELECT a{d}.cell, node, j, c, gl::DOUBLE * gl::DOUBLE / (nl + {bo.L2}) + (gt - gl)::DOUBLE * (gt - gl)::DOUBLE / ((nt - nl) + {bo.L2})
    - gt::DOUBLE * gt::DOUBLE / (nt + {bo.L2}) AS gain
  FROM a{d} JOIN {cells} k ON k.cell = a{d}.cell WHERE nl >= min_rows AND nt - nl >= min_rows) WHERE gain > 0 GROUP BY ALL),
m{d} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN best IS NULL THEN w.node ELSE 2 * w.node + (w.codes[best.j + 1] > best.c)::INT END AS node)
  FROM {before} w LEFT JOIN s{d} s ON s.cell = w.cell AND s.node = w.node)"""


def forest(tag: str, width: int, sql: str, *needs: str) -> str:
    """``sql`` over ``rec`` (rid, t, r, loss): the residual of each row of ``fr_<tag>`` after the last tree, and at
    rid = -(1000 * cell + epoch) the training loss of each epoch."""
    depth = max(p["depth"] for _, _, p in C.TIERS)
    step = {p["step"] for _, _, p in C.TIERS}.pop()
    rows, cells = f"fr_{tag}", f"fk_{tag}"
    loss = "avg((r / 1e9) ** 2)"
    grown = f"""WITH w AS MATERIALIZED (SELECT rec.rid, rec.t, rec.r, b.cell, b.codes, b.tr, k.depth, 1 AS node, b.tr AND {_draw('b.row_no', 'rec.t', bo.SHARE)} AS smp
FROM rec JOIN {rows} b ON b.rid = rec.rid JOIN {cells} k ON k.cell = b.cell WHERE rec.t < k.trees),
{", ".join(_level(d, width, cells) for d in range(1, depth + 1))},
v AS (SELECT cell, node, floor({step} * (sum(r)::DOUBLE / (count(*) + {bo.L2})) + 0.5)::BIGINT AS value FROM m{depth} WHERE smp GROUP BY ALL),
n AS MATERIALIZED (SELECT m.rid, m.t + 1 AS t, m.r - value AS r, m.cell, m.tr FROM m{depth} m JOIN v ON v.cell = m.cell AND v.node = m.node)
SELECT rid, t, r, NULL::DOUBLE AS loss FROM n UNION ALL SELECT -(1000 * cell + t), t, 0, {loss} FROM n WHERE tr GROUP BY cell, t"""
    first = f"SELECT rid, 0 AS t, r0 AS r, NULL::DOUBLE AS loss FROM {rows} UNION ALL SELECT -1000 * cell, 0, 0, avg((r0 / 1e9) ** 2) FROM {rows} WHERE tr GROUP BY cell"
    rec = f"rec(rid, t, r, loss) USING KEY (rid) AS (SELECT * FROM ({first}) UNION SELECT * FROM ({grown}))"
    body = sql.strip()
    return with_parts(f"WITH {rec}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body), rows, cells, *needs, recursive=True)
