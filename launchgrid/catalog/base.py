"""Registration of queries, and the shared inputs in both dialects.

A query lists its output columns once: ``name`` as it is, ``#name`` whole number, ``~name`` double
rounded to six places, ``$name`` text. The list is applied to the DataFrame and to the SQL alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from launchgrid.operators import release, windows
from launchgrid.session import durable_table
from launchgrid.sources import tables


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}
CTES: dict[str, str] = {}


class Data:
    """The given tables as fact views and window tables, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.dir, name)

    @cached_property
    def dense(self) -> DataFrame:
        return tables.dense_facts(self.spark, self.dir)

    @cached_property
    def sparse(self) -> DataFrame:
        return tables.sparse_facts(self.spark, self.dir)

    @cached_property
    def catalog(self) -> DataFrame:
        return tables.catalog_facts(self.spark, self.dir)

    @cached_property
    def releases(self) -> DataFrame:
        """Releases of the sparse view that are not left-censored."""
        return release.release_dates(self.sparse, "wide").where("not left_censored")

    @cached_property
    def starts(self) -> DataFrame:
        return release.first_days(self.dense)

    @cached_property
    def dense_windows(self) -> DataFrame:
        return windows.window_wide(self.dense, self.starts, DENSE_OFFSETS)

    @cached_property
    def dense_wide(self) -> DataFrame:
        """Written, as folds, pairs and openings each go over it."""
        return durable_table(self.dense_windows)

    @cached_property
    def sparse_wide(self) -> DataFrame:
        return durable_table(windows.window_wide(self.sparse, self.releases, SPARSE_OFFSETS))

    @cached_property
    def release_wide(self) -> DataFrame:
        """The sparse windows of offset 0 alone."""
        return durable_table(windows.window_wide(self.sparse, self.releases, (0,)))

    @cached_property
    def pairs(self) -> DataFrame:
        return windows.observed_pairs(self.dense_wide)

    @cached_property
    def rows(self) -> DataFrame:
        return windows.target_rows(self.pairs)

    @cached_property
    def frame(self) -> DataFrame:
        return self.frame_of(self.rows)

    @cached_property
    def opening_frame(self) -> DataFrame:
        """The frame of the windows of offset 0 alone."""
        wide = windows.window_wide(self.dense, self.starts, (0,))
        return durable_table(self.frame_of(windows.target_rows(windows.observed_pairs(wide))))

    def frame_of(self, rows: DataFrame) -> DataFrame:
        """Target rows with two simple predictions, a zero score and a whole-number weight."""
        from launchgrid.functions.scalar import SCALE_EDGES, right_closed_bin

        return rows.withColumn("sb", right_closed_bin(F.col("scale"), SCALE_EDGES)).selectExpr(
            "*", *FRAME_COLUMNS)

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return windows.values_table(self.spark, rows, schema)

    def dates(self, rows: list[tuple], names: list[str], date_cols: list[str]) -> DataFrame:
        raw = self.spark.createDataFrame(rows, names)
        return raw.select(*[F.col(c).cast("date").alias(c) if c in date_cols else F.col(c) for c in names])


DENSE_OFFSETS = tuple(range(21))
SPARSE_OFFSETS = tuple(sorted(windows.OPEN_OFFSETS + windows.MID_OFFSETS))
# The stand-in models of the calibration queries; the text is valid in both dialects.
FRAME_COLUMNS = [
    "weekday(d1) as d1_dow",
    "t3 / scale * (1.0 - 0.08 * (h - 3)) as A",
    "(t1 + t3) / (2.0 * scale) * (1.0 - 0.06 * (h - 3)) as B",
    "cast(h as double) / (h + shw1 + shw2 + shw3) as p0",
    "cast(1 + sb as bigint) as w",
]


NUDGE = "3e-10"


def _columns(spec: str, spark: bool) -> list[str]:
    out = []
    for c in spec.split():
        kind, name = (c[0], c[1:]) if c[0] in "#~$" else ("", c)
        if kind == "#":
            out.append(f"cast({name} as bigint) as {name}")
        elif kind == "~":
            # The nudge moves the half-way point off short decimals, where the last bit of the two
            # engines' arithmetic would decide the sixth place.
            out.append(f"round(cast({name} as double) + {NUDGE}, 6)" + ("" if spark else " + 0.0") + f" as {name}")
        elif kind == "$":
            out.append(f"cast({name} as {'string' if spark else 'varchar'}) as {name}")
        else:
            out.append(name)
    return out


def with_ctes(body: str) -> str:
    """Prefix the shared subqueries the text uses, in the order they were declared."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in CTES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(sql)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in need]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, columns: str, sql: str | None):
    """Register ``fn(data) -> DataFrame`` under a name with its output columns and SQL."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Data(spark, sf_dir)).selectExpr(*_columns(columns, True))

        text = None
        if sql is not None:
            text = with_ctes(f"SELECT {', '.join(_columns(columns, False))} FROM ({sql}) AS _q")
        assert name not in CATALOG, name
        CATALOG[name] = Entry(run, text)
        return fn

    return add


def sql_bin(x: str, edges) -> str:
    arms = " ".join(f"WHEN {x} <= {e} THEN {i}" for i, e in enumerate(edges))
    return f"CASE {arms} ELSE {len(edges)} END"


def sql_hash(*cols: str) -> str:
    hexa = f"substring(md5(concat_ws('|', {', '.join(cols)})), 1, 8)"
    return f"((CAST(CAST(concat('0x', {hexa}) AS UBIGINT) AS BIGINT) * 48271 + 11) % 9973)"


def _wide_sql(facts: str, starts: str, offs: str, guard: bool = True) -> str:
    ends = f" AND wd1 + 9 <= (SELECT max(ds) FROM {facts})" if guard else ""
    day = lambda c, n, ks: ", ".join(
        f"CAST(sum(CASE WHEN h = {k} THEN {c} ELSE 0 END) AS BIGINT) AS {n}{k}" for k in ks)
    occ = ", ".join(f"CAST(sum(CASE WHEN h = {k} THEN rate ELSE 0 END) AS DOUBLE) AS occ{k}" for k in (1, 2, 3))
    return f"""SELECT item, site, off, min(wd1) AS d1, arg_min(city, ds) AS city,
      {day('1', 'n', (1, 2, 3))}, {day('qty', 't', (1, 2, 3))}, {day('slots', 'shw', (1, 2, 3))}, {occ},
      {day('qty', 'q', range(4, 11))}, {day('slots', 's', range(4, 11))}
      FROM (SELECT f.item, f.site, f.city, f.ds, f.qty, f.slots, f.rate, o.off, a.d1 + o.off AS wd1,
                   date_diff('day', a.d1 + o.off, f.ds) + 1 AS h
            FROM {facts} f JOIN {starts} a ON f.item = a.item CROSS JOIN {offs} o) x
      WHERE h BETWEEN 1 AND 10{ends}
      GROUP BY item, site, off"""


def _rows_sql(pairs: str) -> str:
    pick = lambda c: "CASE hh.h " + " ".join(f"WHEN {k} THEN {c}{k}" for k in range(4, 11)) + " END"
    return f"""SELECT p.*, hh.h, {pick('q')} AS qty, {pick('s')} AS fslots, p.d1 + (hh.h - 1) AS ds,
      {pick('q')} / p.scale AS y
      FROM {pairs} p CROSS JOIN (SELECT CAST(unnest([4,5,6,7,8,9,10]) AS INTEGER) AS h) hh"""


def _offs_sql(offsets) -> str:
    return f"SELECT CAST(unnest([{','.join(map(str, offsets))}]) AS INTEGER) AS off"


_event = """SELECT {item} AS item, event_type AS site, CAST(ts AS DATE) AS ds,
  CAST(round(value) AS BIGINT) AS v FROM events"""
_daily = """SELECT item, site, concat('c', CAST(length(site) % 3 AS VARCHAR)) AS city, ds,
  CAST(sum(v) AS BIGINT) AS qty, CAST(count(*) AS BIGINT) AS slots, sum(v) * 1.0 / count(*) AS rate
  FROM ({src}) e GROUP BY item, site, ds"""

CTES["fd"] = _daily.format(src=_event.format(item="CAST(user_id // 2 AS VARCHAR)"))
CTES["fs"] = _daily.format(src=_event.format(
    item="concat(CAST(user_id AS VARCHAR), '_', CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR))"))
CTES["fc"] = """SELECT item, site, concat('r', CAST(CAST(site AS INTEGER) % 5 AS VARCHAR)) AS city, ds,
  CAST(sum(q) AS BIGINT) AS qty, CAST(count(*) AS BIGINT) AS slots, sum(q) * 1.0 / count(*) AS rate
  FROM (SELECT p_brand AS item, CAST(s_nationkey AS VARCHAR) AS site, CAST(l_shipdate AS DATE) AS ds,
               CAST(l_quantity AS BIGINT) AS q
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) c
  GROUP BY item, site, ds"""
CTES["dayn_s"] = "SELECT item, ds, count(*) AS sites FROM fs GROUP BY item, ds"


def release_sql(share: float, days: int | None, least: int) -> str:
    span = f"WHERE ds <= first_ds + {days - 1}" if days else ""
    return f"""SELECT item, min(first_ds) AS first_ds, min(ds) AS d1,
      date_diff('day', min(first_ds), min(ds)) AS shift,
      min(first_ds) = (SELECT min(ds) FROM fs) AS left_censored
      FROM (SELECT *, max(sites) OVER (PARTITION BY item) AS peak
            FROM (SELECT *, min(ds) OVER (PARTITION BY item) AS first_ds FROM dayn_s) a {span}) b
      WHERE sites >= greatest({least}, {share} * peak) GROUP BY item"""


CTES["rel_all"] = release_sql(0.5, 21, 0)
CTES["rel_s"] = "SELECT * FROM rel_all WHERE NOT left_censored"
CTES["st_d"] = "SELECT item, min(ds) AS d1, max(ds) AS last_ds FROM fd GROUP BY item"
CTES["offs_d"] = _offs_sql(DENSE_OFFSETS)
CTES["offs_s"] = _offs_sql(SPARSE_OFFSETS)
CTES["wd"] = _wide_sql("fd", "st_d", "offs_d")
CTES["ws"] = _wide_sql("fs", "rel_s", "offs_s")
CTES["pd"] = "SELECT *, greatest((t1 + t2 + t3) / 3.0, 1.0) AS scale FROM wd WHERE t3 > 0"
CTES["ps"] = "SELECT *, greatest((t1 + t2 + t3) / 3.0, 1.0) AS scale FROM ws WHERE t3 > 0"
CTES["gd"] = _rows_sql("pd")
CTES["gs"] = _rows_sql("ps")
# Windows of which D3 is known, whether or not the facts reach to their last day.
CTES["wo"] = _wide_sql("fs", "rel_s", "offs_s", guard=False)
CTES["po"] = "SELECT *, greatest((t1 + t2 + t3) / 3.0, 1.0) AS scale FROM wo WHERE t3 > 0"
CTES["go"] = _rows_sql("po")
CTES["fr"] = "SELECT *, " + ", ".join(FRAME_COLUMNS).replace("weekday(d1)", "isodow(d1) - 1") + \
    f" FROM (SELECT *, {sql_bin('scale', (2, 5, 10, 25, 50, 100, 250))} AS sb FROM gd) z"
