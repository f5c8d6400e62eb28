"""Registry and SQL building blocks.

A check cuts its double columns to 6 decimals on both sides with the same rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlattice.sources import derived as D

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# Derived tables as SQL, the same definitions as emberlattice.sources.derived.
_DATE = "DATE '2017-01-03' + CAST(5*(l_orderkey%73) AS INTEGER)"
_RES = (
    "((date_diff('day', DATE '2017-01-01', date)*31 + CAST(round(latitude*1000) AS BIGINT)*7"
    " + (CAST(round(longitude*1000) AS BIGINT)+200000)*13) % 11)"
)
CTES = {
    "grid_daily": f"""SELECT {_DATE} AS date,
 CAST(36750+250*(CAST(floor(l_partkey/14) AS INTEGER)%22) AS DOUBLE)/1000 AS latitude,
 CAST(-9500+250*CAST(l_partkey%14 AS INTEGER) AS DOUBLE)/1000 AS longitude,
 sum(l_quantity)/count(*) AS fwi,
 CAST(273 AS DOUBLE)+CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/count(*)/300000 AS temperature_max,
 CASE WHEN sum(l_linenumber)%7=0 THEN NULL ELSE CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE)/count(*)/10 END AS total_precipitation,
 CAST(260 AS DOUBLE)+CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/count(*)*2 AS dewpoint
 FROM lineitem GROUP BY 1,2,3""",
    "fine_pred": f"""SELECT {_DATE} AS date,
 CAST(36750+250*(CAST(floor(l_partkey/14) AS INTEGER)%22)+10*(CAST((l_orderkey*7+l_linenumber*3)%25 AS INTEGER)-12) AS DOUBLE)/1000 AS latitude,
 CAST(-9500+250*CAST(l_partkey%14 AS INTEGER)+10*(CAST((l_orderkey*5+l_suppkey*11)%25 AS INTEGER)-12) AS DOUBLE)/1000 AS longitude,
 l_quantity*9/10+l_suppkey%7 AS fwi_predicted FROM lineitem""",
    "exposure": """SELECT p_partkey AS point_id, CAST(36850+13*(p_partkey%400) AS DOUBLE)/1000 AS latitude,
 CAST(-9400+17*((p_partkey*7)%190) AS DOUBLE)/1000 AS longitude,
 CAST(CAST(round(p_retailprice*100-89000) AS BIGINT)*p_size AS DOUBLE)/100 AS value FROM part""",
    "landcover_pixels": """SELECT CAST(floor(o_orderkey/120) AS INTEGER) AS pix_row, CAST(o_orderkey%120 AS INTEGER) AS pix_col,
 CASE WHEN o_custkey%12=11 THEN 0 WHEN o_custkey%12=10 THEN 95 ELSE 10*(1+CAST(o_custkey%12 AS INTEGER)) END AS landcover FROM orders""",
    "fwi_daily": f"SELECT date, latitude, longitude, fwi FROM grid_daily WHERE {_RES} <> 0",
    "temp_daily": f"SELECT date, latitude, longitude, temperature_max FROM grid_daily WHERE {_RES} <> 1",
    "atmos_daily": f"SELECT date, latitude, longitude, dewpoint, total_precipitation FROM grid_daily WHERE {_RES} <> 2",
    "pred_models": "SELECT m.model, f.date, f.latitude, f.longitude, f.fwi_predicted + m.o AS fwi_predicted"
    " FROM fine_pred f, (VALUES "
    + ", ".join(f"('{m}', CAST({o} AS DOUBLE))" for m, o in D.MODEL_OFFSETS.items())
    + ") m(model, o)",
    "features_importance": f"""SELECT ({D.IMPORTANCE_MODELS!r})[mi+1] AS model, ({D.IMPORTANCE_FEATURES!r})[fi+1] AS feature, a/b AS score FROM (
 SELECT l_suppkey%{len(D.IMPORTANCE_MODELS)} AS mi, (l_partkey*5+l_suppkey)%{len(D.IMPORTANCE_FEATURES)} AS fi,
 sum(l_quantity*(l_linenumber-1)) AS a, sum(l_quantity*7) AS b FROM lineitem GROUP BY 1,2) WHERE (mi*3+fi)%7<>0""",
}
NEEDS = {
    "fwi_daily": ["grid_daily"], "temp_daily": ["grid_daily"], "atmos_daily": ["grid_daily"],
    "pred_models": ["fine_pred"],
}


def tk(x: str) -> str:
    """Degrees to integer ticks."""
    return f"CAST(round_even(({x})*10000, 0) AS BIGINT)"


# Means of cents and other short decimals often sit exactly between two roundings, where the last
# bit of a sum decides. The compared values are therefore cut at an off-centre point, on both sides.
CUT = 0.2137


def rnd(x: str, digits: int = 6) -> str:
    return f"(round_even(({x})*1e{digits}+{CUT}::DOUBLE, 0)/1e{digits}+0.0)"


def cut(c: str, digits: int = 6):
    scale = float(10**digits)
    return F.rint(F.col(c) * scale + F.lit(CUT)) / scale + F.lit(0.0)


# The digest of a daily row that samples and splits go by.
DIGEST = ("md5(concat_ws('|', CAST(date AS VARCHAR), CAST(CAST(round_even(latitude*10000,0) AS BIGINT) AS VARCHAR),"
          " CAST(CAST(round_even(longitude*10000,0) AS BIGINT) AS VARCHAR), '42'))")


def build(body: str, tables: list[str] = (), steps: list[tuple[str, str]] = ()) -> str:
    """WITH <derived tables>, <steps> body."""
    order: list[str] = []
    for t in tables:
        order += [d for d in [*NEEDS.get(t, []), t] if d not in order]
    parts = [f"{t} AS ({CTES[t]})" for t in order] + [f"{n} AS ({q})" for n, q in steps]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _spec(doubles) -> dict[str, int]:
    return doubles if isinstance(doubles, dict) else {c: 6 for c in doubles}


def check(name: str, sql: str | None, doubles=()):
    """Register a query; ``doubles`` names the columns rounded on both sides."""
    spec = _spec(doubles)

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: cut(c, d) for c, d in spec.items()}) if spec else df

        text = sql
        if sql is not None and spec:
            swaps = ", ".join(f'{rnd(chr(34) + c + chr(34), d)} AS "{c}"' for c, d in spec.items())
            text = f"SELECT * REPLACE ({swaps}) FROM (\n{sql}\n) AS result"
        REGISTRY[name] = (run, text)
        return fn

    return register
