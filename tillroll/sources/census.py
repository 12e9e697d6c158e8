"""Census lookups re-aimed as Spark jobs over *landed* responses.

The dashboard called the geocoder once per store and the ACS API once per
tract, in a sequential loop. Here an external fetcher lands the raw
responses as rows (key columns, ``payload`` text, ``fetched_at``); these
functions parse them with ``from_json`` across the cluster and compute the
work list of keys still to fetch. No HTTP happens inside Spark tasks.

S9 ``parse_geocode``, S10 ``parse_tract_acs``, S11 ``parse_county_acs``,
S13 ``pending_keys``. ``quarantine`` sets unusable responses apart, each with
its reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import id_text
from tillroll.sources.schemas import ACS_VARS, GEOCODE_JSON, TABLE_JSON, TRACT_KEYS


def _kept(raw: DataFrame, keep: Sequence[str]) -> list[str]:
    return [c for c in keep if c in raw.columns]


def parse_geocode(raw: DataFrame, id_col: str = "STORE_ID", payload_col: str = "payload",
                  keep: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Store -> (STATEFP, COUNTYFP, TRACT) from geocoder responses.

    The first listed tract is used. An empty tract list, malformed text or a
    missing field gives NULL keys (the store row is kept), as a failed
    lookup did in the dashboard.
    """
    parsed = F.from_json(F.col(payload_col), GEOCODE_JSON)
    first = F.get(parsed["result"]["geographies"]["Census Tracts"], 0)
    return raw.select(
        id_text(F.col(id_col)).alias("STORE_ID"),
        first["STATE"].alias("STATEFP"),
        first["COUNTY"].alias("COUNTYFP"),
        first["TRACT"].alias("TRACT"),
        *_kept(raw, keep),
    )


def parse_tract_acs(raw: DataFrame, payload_col: str = "payload", variables: Sequence[str] = ACS_VARS,
                    keep: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Tract keys + the ACS variables from a tract response.

    The response is ``[header, row]``; the row's last three entries are the
    geography codes, the rest are the requested variables in request order.
    A header-only (or malformed, or empty-row) response yields no row. Values
    stay text, exactly as served (annotation codes included).
    """
    a = F.from_json(F.col(payload_col), TABLE_JSON)
    row = F.get(a, 1)
    vals = F.slice(row, 1, F.greatest(F.size(row) - 3, F.lit(0)))
    kept = _kept(raw, keep)
    keyed = raw.select(*TRACT_KEYS, vals.alias("_v"), *kept).where(F.col("_v").isNotNull() & (F.size("_v") > 0))
    return keyed.select(*TRACT_KEYS, *[F.get("_v", i).alias(v) for i, v in enumerate(variables)], *kept)


def parse_county_acs(raw: DataFrame, payload_col: str = "payload", variables: Sequence[str] = ACS_VARS,
                     extra: Sequence[str] = ("NAME", "state", "county"),
                     keep: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """County rows from responses whose first row is the header.

    Any number of responses (one per state, or one for all counties) may be
    landed; each is exploded into its data rows and columns are looked up by
    header name, so column order in the response does not matter and a short
    row gives NULLs rather than an error.
    """
    a = F.from_json(F.col(payload_col), TABLE_JSON)
    kept = _kept(raw, keep)
    rows = raw.select(F.get(a, 0).alias("_h"), F.explode(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).alias("_r"),
                      *kept)
    names = list(variables) + list(extra)
    return rows.select(*[F.get("_r", F.array_position("_h", n).cast("int") - 1).alias(n) for n in names], *kept)


# Reasons why a response is unusable, in the order in which they are tested.
EMPTY, MALFORMED, NO_TRACT, MISSING_FIELD = "empty", "malformed", "no_tract", "missing_field"
NO_HEADER, HEADER_ONLY, SHORT_ROW, NEVER_FETCHED = "no_header", "header_only", "short_row", "never_fetched"


def _reason(kind: str, text: Column, parsed: Column, is_json: Column, variables: Sequence[str]) -> Column:
    broken = F.when(text.isNull() | (F.trim(text) == ""), EMPTY).when(~is_json, MALFORMED)
    if kind == "geocode":
        tracts = parsed["result"]["geographies"]["Census Tracts"]
        first = F.get(tracts, 0)
        fields = [first[c].isNull() for c in ("STATE", "COUNTY", "TRACT")]
        return broken.when(tracts.isNull(), MALFORMED).when(F.size(tracts) == 0, NO_TRACT).when(fields[0] | fields[1] | fields[2], MISSING_FIELD)
    header = F.get(parsed, 0)
    short = F.exists(parsed, lambda row: row.isNull() | (F.size(row) < F.size(header)))
    broken = broken.when(parsed.isNull() | header.isNull(), MALFORMED)
    if kind == "county":
        named = F.size(F.array_except(F.array(*[F.lit(n) for n in (*variables, "NAME", "state", "county")]), header)) == 0
        broken = broken.when(~named, NO_HEADER)
    return broken.when(F.size(parsed) < 2, HEADER_ONLY).when(short, SHORT_ROW)


def _parsed(kind: str, text: Column) -> tuple[Column, Column]:
    """The response by its schema, and whether it is JSON at all."""
    if kind not in ("geocode", "tract", "county"):
        raise ValueError(f"kind must be geocode, tract or county, not {kind!r}")
    return F.from_json(text, GEOCODE_JSON if kind == "geocode" else TABLE_JSON), F.try_parse_json(text).isNotNull()


def reason(kind: str, payload_col: str = "payload", variables: Sequence[str] = ACS_VARS) -> Column:
    """Why a landed response can't be used in full; NULL for a good one. ``kind``: geocode, tract or county.

    ``empty``: no text; ``malformed``: not JSON, or JSON of another shape; geocode: ``no_tract`` (no tract listed),
    ``missing_field`` (the first one lacks a code); tract: ``header_only``, ``short_row`` (fewer entries than the header);
    county: ``no_header`` (a column is not named), ``header_only``, ``short_row`` (in any of the rows).

    As one expression it parses a response once for each use; ``quarantine`` parses it once.
    """
    text = F.col(payload_col)
    return _reason(kind, text, *_parsed(kind, text), variables)


def quarantine(raw: DataFrame, kind: str, keys: Sequence[str] = (), payload_col: str = "payload") -> DataFrame:
    """The unusable responses: their keys, ``reason`` and text (and ``fetched_at`` where there is one).

    Text, parsed response and reason are columns of their own, so each response is made and parsed once. The reason
    leaves as a list of one or none: a filter on it would be pushed below the parsing, all of it written out again
    for each use.
    """
    kept = [*dict.fromkeys([*keys, payload_col, *_kept(raw, ["fetched_at"])])]
    parsed, is_json = _parsed(kind, F.col(payload_col))
    opened = raw.select(*kept, parsed.alias("_parsed"), is_json.alias("_is_json"))
    why = _reason(kind, F.col(payload_col), F.col("_parsed"), F.col("_is_json"), ACS_VARS)
    found = opened.select(*kept, F.explode(F.array_compact(F.array(why))).alias("reason"))
    return found.select(*keys, "reason", payload_col, *_kept(raw, ["fetched_at"]))


def reason_counts(raws: Mapping[str, DataFrame], payload_col: str = "payload") -> DataFrame:
    """(source, reason, n) over the landed responses by kind."""
    parts = [quarantine(df, kind, (), payload_col).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("source"), "reason", "n")
             for kind, df in raws.items()]
    return reduce(DataFrame.unionByName, parts)


def work_list(pending: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S13 with reasons: each pending key, and why its latest response failed (``never_fetched``: it has none)."""
    keys = list(keys)
    bad = bad if "fetched_at" not in bad.columns else latest(bad, keys)
    last = bad.groupBy(*keys).agg(F.max("reason").alias("reason"))
    return pending.join(last, keys, "left").withColumn("reason", F.coalesce("reason", F.lit(NEVER_FETCHED)))


def latest(df: DataFrame, keys: Sequence[str], ts_col: str = "fetched_at", ok: Column | None = None) -> DataFrame:
    """The most recent landed row per key (a key fetched again replaces its
    older response); with ``ok``, the most recent one that is, so a failed
    retry does not erase an earlier success. One aggregate per key; versions
    per key are few.

    ``max`` of a struct led by the flag and the timestamp compares field by
    field, so responses landed at the same instant still resolve
    deterministically.
    """
    others = [ts_col] + [c for c in df.columns if c not in keys and c != ts_col]
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    newest = F.max(F.struct(good.alias("_ok"), *others)).alias("_n")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_n.{c}").alias(c) for c in others])


def pending_stores(stores: DataFrame, store_tract: DataFrame) -> DataFrame:
    """S13 for stores: those never geocoded, or geocoded without a tract, to fetch next."""
    done = store_tract.where(F.col("TRACT").isNotNull()).select("STORE_ID").distinct()
    columns = [c for c in ("LATITUDE", "LONGITUDE") if c in stores.columns]
    return stores.select(id_text("STORE_ID").alias("STORE_ID"), *columns).join(done, "STORE_ID", "left_anti")


def pending_keys(keys: DataFrame, landed: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct complete keys not landed yet (incremental work list).

    ``distinct`` hash-partitions on the keys; the anti join then reuses that
    partitioning and only shuffles the landed side.
    """
    cols = list(cols)
    wanted = keys.select(*cols).dropna(subset=cols).distinct()
    return wanted.join(landed.select(*cols), cols, "left_anti")
