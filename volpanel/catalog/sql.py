"""Common table expressions of the DuckDB checks.

Each expression is written on its own terms (self joins, ordered lists, closed
forms), not as a copy of the Spark plan it checks.
"""

from volpanel.config import HORIZONS

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    _PARTS[name] = (needs, body.strip())


def with_parts(sql: str, *names: str, recursive: bool = False) -> str:
    """``WITH`` the named parts and whatever they need, then ``sql``."""
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in _PARTS[n][0]:
            visit(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in seen)
    head = "WITH RECURSIVE " if recursive else "WITH "
    sql = sql.strip()
    return head + body + (",\n" + sql[5:] if sql.upper().startswith("WITH ") else "\n" + sql)


def rd(expr: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0"


part("obs", """
SELECT o.o_orderpriority AS series_id, CAST(o.o_orderdate AS DATE) AS obs_date,
       avg(o.o_totalprice) AS price, avg(l.q) AS implied, avg(l.e) AS idx_a, avg(l.d) AS idx_b
FROM orders o JOIN (
  SELECT l_orderkey, avg(l_quantity) AS q, avg(l_extendedprice) AS e,
         avg(l_extendedprice * (1 - l_discount)) AS d
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
GROUP BY 1, 2""")

part("num", """
SELECT *, CAST(year(obs_date) AS INT) AS year,
       row_number() OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS row_no
FROM obs""", "obs")

part("rets", """
SELECT *, ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY row_no)) AS ret FROM num""",
     "num")


def _guarded(fn: str, col: str, frame: str, n: int) -> str:
    w = f"(PARTITION BY series_id ORDER BY row_no ROWS BETWEEN {frame})"
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {fn}({col}) OVER {w} END"


def fwd(h: int) -> str:
    return _guarded("stddev_samp", "ret", f"1 FOLLOWING AND {h} FOLLOWING", h)


def past(n: int) -> str:
    return _guarded("stddev_samp", "ret", f"{n} PRECEDING AND 1 PRECEDING", n)


def lag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY series_id ORDER BY row_no)"


part("wide", f"""
SELECT *, {', '.join(f'{fwd(h)} AS target_vol_{h}, {past(h)} AS past_vol_{h}' for h in HORIZONS)}
FROM rets""", "rets")

part("har", f"""
SELECT *, abs({lag('ret', 1)}) AS har_daily, {past(5)} AS price_vol5, {past(20)} AS price_vol20,
  {lag('implied', 1)} AS implied_lag1, {lag('idx_a', 1)} AS idx_a_lag1, {lag('idx_b', 1)} AS idx_b_lag1
FROM wide""", "wide")

part("long", " UNION ALL ".join(f"""
SELECT series_id, obs_date, year, row_no, {h} AS horizon, target_vol_{h} AS y,
  past_vol_{h} AS past_vol, har_daily, price_vol5, price_vol20, implied_lag1, idx_a_lag1, idx_b_lag1
FROM har""" for h in HORIZONS), "har")

part("folds", """
SELECT series_id, year AS test_year, min(row_no) AS first_test FROM num
WHERE year BETWEEN 1998 AND 2001 GROUP BY 1, 2""", "num")

# complete HAR rows; every regressor of the wider variants is then complete too
part("train", """
SELECT l.*, f.test_year FROM long l JOIN folds f
  ON l.series_id = f.series_id AND l.year < f.test_year AND l.row_no + l.horizon < f.first_test
WHERE y IS NOT NULL AND har_daily IS NOT NULL AND price_vol5 IS NOT NULL AND price_vol20 IS NOT NULL
""", "long", "folds")

part("test", """
SELECT l.*, l.year AS test_year, NOT (l.year = 2001 AND l.horizon >= 66) AS include_in_main
FROM long l
WHERE l.year BETWEEN 1998 AND 2001 AND y IS NOT NULL
  AND har_daily IS NOT NULL AND price_vol5 IS NOT NULL AND price_vol20 IS NOT NULL""", "long")

part("fold_stats", """
SELECT series_id, horizon, test_year, count(*) AS n_train, avg(y) AS train_mean, min(y) AS floor
FROM train GROUP BY 1, 2, 3""", "train")
