"""Raw payload text to typed rows.

Every parser is a projection over the rows that carry the payloads: JSON, CSV and report
text are opened with built-in functions, arrays are exploded in place and cross-row checks
inside one payload use array functions, so parsing needs no shuffle and reads a payload once.
Bad payloads are never dropped silently: every parser returns one frame with a `problem`
column, in which a refused payload is one row that names its problem and has no values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import col, null_if, prev_sunday


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NULL").drop("problem")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NOT NULL")


def _open(df: DataFrame, keep: Sequence[str], problem: Column, items: Column) -> DataFrame:
    """keep, problem and _x: the items of payloads without a problem, or one row for the problem."""
    marked = df.withColumn("problem", problem)
    rows = marked.select(*keep, "problem", F.explode_outer(F.when(F.col("problem").isNull(), items)).alias("_x"))
    return rows.filter(F.col("problem").isNotNull() | F.col("_x").isNotNull())


# ------------------------------------------------------------------ JSON


def parse_nested_series(df: DataFrame, body: str, measures: Sequence[str]) -> DataFrame:
    """Map of maps (measure -> day -> value) to one row per day; the fill value becomes NULL."""
    schema = (
        "header struct<fill_value:double>, properties struct<parameter:map<string,map<string,double>>>, detail string"
    )
    parsed = df.withColumn("_p", F.from_json(body, schema))
    series = F.col("_p.properties.parameter")
    sizes = F.array_distinct(F.transform(F.map_values(series), lambda m: F.size(m)))
    problem = (
        F.when(F.col("_p.detail").isNotNull(), "rejected request")
        .when(series.isNull() | (F.size(series) == 0), "no series")
        .when(F.size(sizes) != 1, "series of unequal length")
    )
    fill = F.coalesce(F.col("_p.header.fill_value"), F.lit(-999.0))
    keep = [c for c in df.columns if c != body]

    def day(d: Column) -> Column:
        cells = [F.try_element_at(F.try_element_at(series, F.lit(m)), d) for m in measures]
        return F.struct(F.to_date(d, "yyyyMMdd").alias("d"), *[F.when(v != fill, v).alias(m) for m, v in zip(measures, cells)])

    days = F.transform(F.map_keys(F.element_at(F.map_values(series), 1)), day)
    return _open(parsed, keep, problem, days).select(*keep, "_x.*", "problem")


def parse_records(df: DataFrame, body: str, fields: str, required: Sequence[str], type_field: str, expect: int) -> DataFrame:
    """Array of records; refuses strings, objects, empty arrays, missing fields and mixed statistic types."""
    text = F.ltrim(F.col(body))
    parsed = df.withColumn("_r", F.when(text.startswith("["), F.from_json(body, f"array<struct<{fields}>>")))

    def gap(r: Column) -> Column:
        return F.array_contains(F.array(*[r[c].isNull() for c in required]), True)

    lacks = F.exists("_r", gap)
    problem = (
        F.when(text.startswith('"'), "error string").when(text.startswith("{"), "error object")
        .when(F.col("_r").isNull(), "not a list").when(F.size("_r") == 0, "zero rows").when(lacks, "missing field")
        .when(F.exists("_r", lambda r: r[type_field] != expect), "wrong statistic type")
    )
    keep = [c for c in df.columns if c != body]
    return _open(parsed, keep, problem, F.col("_r")).select(*keep, "_x.*", "problem")


def parse_parallel_arrays(df: DataFrame, body: str, granularity: str, fields: Sequence[str], close: str) -> DataFrame:
    """timestamp || value arrays to bars; the session date is read in the exchange's offset."""
    arrays = ", ".join(f"{f}:array<double>" for f in fields)
    schema = f"meta struct<dataGranularity:string,gmtoffset:int>, timestamp array<bigint>, quote struct<{arrays}>"
    parsed = df.withColumn("_p", F.from_json(body, schema))
    n = F.size("_p.timestamp")
    uneven = F.lit(False)
    for f in fields:
        a = F.col(f"_p.quote.{f}")
        uneven = uneven | (a.isNotNull() & (F.size(a) != n))
    problem = (
        F.when(F.col("_p.timestamp").isNull() | (n == 0), "no timestamps")
        .when(F.col("_p.meta.dataGranularity") != granularity, "wrong granularity")
        .when(uneven, "arrays of unequal length")
    )
    keep = [c for c in df.columns if c != body]
    offset = F.coalesce(F.col("_p.meta.gmtoffset"), F.lit(0))
    values = [F.coalesce(F.col(f"_p.quote.{f}"), F.array_repeat(F.lit(None).cast("double"), F.coalesce(n, F.lit(0)))).alias(f) for f in fields]

    def bar(x: Column) -> Column:
        day = F.date_from_unix_date(F.floor((x["_ts"] + offset) / F.lit(86400)).cast("int"))
        return F.struct(day.alias("d"), *[x[f].alias(f) for f in fields])

    bars = F.transform(F.arrays_zip(F.col("_p.timestamp").alias("_ts"), *values), bar)
    closed = F.filter(bars, lambda x: x[close].isNotNull())
    return _open(parsed, keep, problem, closed).select(*keep, "_x.*", "problem")


def parse_quantities(df: DataFrame, body: str) -> DataFrame:
    """Statistics records: thousands separators, withheld figures to NULL plus their flag.

    A payload without a data list is refused with its own error text; a figure that is neither a number
    nor a flag is refused by itself.
    """
    fields = "state_code:string,county_code:string,year:string,Value:string"
    parsed = df.withColumn("_p", F.from_json(body, f"data array<struct<{fields}>>, error array<string>"))
    problem = F.when(
        F.col("_p.data").isNull(),
        F.when(F.size("_p.error") > 0, F.concat(F.lit("refused: "), F.array_join("_p.error", "; "))).otherwise("no data"),
    ).when(F.size("_p.data") == 0, "zero rows")
    keep = [c for c in df.columns if c != body]
    r = _open(parsed, keep, problem, F.col("_p.data"))
    text = F.trim(F.col("_x.Value"))
    flag = F.when(text.startswith("(") & text.endswith(")"), F.trim(F.translate(text, "()", "")))
    number = F.regexp_replace(text, ",", "").try_cast("double")
    unread = F.col("_x").isNotNull() & flag.isNull() & number.isNull()
    return r.select(
        *keep,
        F.concat(F.lpad("_x.state_code", 2, "0"), F.lpad("_x.county_code", 3, "0")).alias("area"),
        F.col("_x.year").try_cast("int").alias("year"),
        F.when(flag.isNull(), number).alias("quantity"), flag.alias("flag"),
        # A combined-areas row is a remainder, not a place.
        (F.col("_x.county_code") != "998").alias("is_area"),
        F.coalesce("problem", F.when(unread, "not a figure")).alias("problem"),
    )


# ------------------------------------------------------------------ CSV


def unpivot_month_slots(df: DataFrame, line: str, missing: float, slots: int = 31, meta: int = 6) -> DataFrame:
    """Fixed 31-slot month rows to days; the month's length comes from the calendar, not the slots."""
    parts = df.withColumn("_f", F.split(line, ","))
    problem = F.when(F.size("_f") != slots + meta, "wrong number of fields")
    first = F.make_date(F.trim(F.get("_f", F.lit(3))).try_cast("int"), F.trim(F.get("_f", F.lit(4))).try_cast("int"), F.lit(1))
    days = F.slice("_f", F.lit(meta + 1), F.dayofmonth(F.last_day(first)))
    keep = [c for c in df.columns if c != line]

    def slot(v: Column, i: Column) -> Column:
        return F.struct(
            F.trim(F.get("_f", F.lit(1))).alias("area"), F.lower(F.trim(F.get("_f", F.lit(5)))).alias("measure"),
            F.date_add(first, i).alias("d"), null_if(F.trim(v).try_cast("double"), missing).alias("value"),
        )

    return _open(parts, keep, problem, F.transform(days, slot)).select(*keep, "_x.*", "problem")


def single_measure(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns plus the one column that is not a key, renamed to `value`."""
    rest = [c for c in df.columns if c not in set(keys)]
    if len(rest) != 1:
        raise ValueError(f"expected exactly one measure beside {list(keys)}, found {rest}")
    return df.select(*keys, null_if(F.col(f"`{rest[0]}`").try_cast("double")).alias("value"), F.lit(rest[0]).alias("measure"))


def read_single_measure(spark, path: str, keys: Sequence[str]) -> DataFrame:
    return single_measure(spark.read.option("header", True).csv(path), keys)


# ------------------------------------------------------------------ sidecars and reports

def _after(text: Column, words: str) -> Column:
    """What follows some words, up to the end of the line; NULL where they are absent."""
    return F.trim(F.get(F.split(F.get(F.split(text, words, 2), F.lit(1)), r"\r?\n"), F.lit(0)))


def _token(text: Column) -> Column:
    return F.get(F.split(text, r"\s+"), F.lit(0))


def parse_version_text(c: str | Column) -> dict[str, Column]:
    """Coverage window, state and provenance of a version sidecar; absent parts are NULL.

    The head is the line whose fourth and sixth words are `for` and `through`; it names product,
    version, state, and the first and last day covered. Recent files name the build of the station
    data they were made from, older ones the time it was downloaded.
    """
    text = col(c)
    words = F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+"))
    head = F.get(F.filter(words, lambda w: (F.get(w, F.lit(3)) == "for") & (F.get(w, F.lit(5)) == "through")), F.lit(0))
    state = F.get(head, F.lit(2))
    known = state.isin("complete", "prelim")
    start, end = F.get(head, F.lit(4)).try_cast("date"), F.get(head, F.lit(6)).try_cast("date")
    return {
        "state": F.when(known, state), "covers_start": start, "covers_end": end,
        "created_on": F.substring(_after(text, "created on"), 1, 10).try_cast("date"),
        "software": _token(_after(text, "software ")), "build": _token(_after(text, "from GHCN-Daily ")),
        "downloaded": _after(text, "downloaded on "),
        "problem": F.when(head.isNull(), "no head line").when(~known, "unknown state").when(start.isNull() | end.isNull(), "unreadable coverage"),
    }


# Titles and columns of the weekly report's tables.
TITLE = " - Selected States"
CONDITION = ("very_poor", "poor", "fair", "good", "excellent")
COMPARISONS = ("previous_year", "previous_week", "current", "five_year_average")
STAGES = {"doughing": "dough", "dent": "dented"}
# Words of a notice that a release is late or cancelled.
NOTICE = ("delayed", "delay ", "postpon", "cancel", "suspend", "will not be issued", "not be released")


def parse_report(df: DataFrame, text: str, crop: str, expected: str | None = None) -> DataFrame:
    """A weekly progress and condition report to long observations of one crop.

    The text is cut at its table titles; a table's rows have a label, a dot leader, a colon and
    values, where `-` is 0 and `(NA)` is NULL. Condition tables have five categories, for states and
    for the aggregate now, a week ago and a year ago; progress tables have four comparisons. The
    release date stands in words; the report is out at 16:00 US Eastern and speaks about the Sunday
    before. Condition figures of a state that do not add up to 100 are flagged; those of the aggregate,
    figures outside 0..100, a row with another number of values, a date that is not the expected one,
    a notice, and a report without the crop are problems. `expected` names a date column.
    """
    keep = [c for c in df.columns if c != text]
    parts = df.withColumn("_parts", F.split(F.col(text), TITLE))
    said = F.substring_index(F.regexp_replace(_after(F.col(text), "(?i)released "), r"\s+", " "), " ", 3)
    parts = parts.withColumn("_released", F.try_to_date(F.regexp_replace(F.initcap(said), ",$", ""), "MMMM d, yyyy"))
    n = F.size("_parts")

    def table(i: Column) -> Column:
        above = F.get("_parts", i - 1)
        title = F.trim(F.element_at(F.split(above, r"\r?\n"), -1))
        return F.struct(F.lower(F.regexp_replace(title, r"\s+", " ")).alias("title"), F.get("_parts", i).alias("body"))

    tables = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), table)).otherwise(F.array().cast("array<struct<title:string,body:string>>"))
    parts = parts.withColumn("_tables", F.filter(tables, lambda x: x["title"].startswith(crop.lower() + " ")))
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    notice = ~low.contains(TITLE.strip(" -").lower()) & F.array_contains(F.array(*[low.contains(w) for w in NOTICE]), True)
    problem = F.when(F.col("_released").isNull(), F.when(notice, "release notice").otherwise("no release date"))
    if expected is not None:
        problem = problem.when(F.col(expected) != F.col("_released"), "date is not the listed one")
    problem = problem.when(F.size("_tables") == 0, "no table of the crop")

    def rows(x: Column) -> Column:
        cells = F.transform(F.split(x["body"], r"\r?\n"), lambda line: F.split(line, r"\.{2,}\s*:", 2))
        return F.transform(
            F.filter(cells, lambda c: F.size(c) == 2),
            lambda c: F.struct(
                x["title"].alias("title"), F.trim(F.regexp_replace(c[0], r"\s+", " ")).alias("label"),
                F.filter(F.split(F.trim(c[1]), r"\s+"), lambda v: v != "").alias("values"),
            ),
        )

    r = _open(parts.withColumn("_rows", F.flatten(F.transform("_tables", rows))), [*keep, "_released"], problem, F.col("_rows"))
    stage = F.substring(F.col("_x.title"), len(crop) + 2, 100)
    stages = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    condition = stage == "condition"
    label = F.lower("_x.label")
    total = label.isin("previous week", "previous year") | label.rlike(r"^\d+ states$")
    values = F.transform("_x.values", lambda v: F.when(v == "-", 0.0).when(v != "(NA)", v.try_cast("double")))
    unread = F.exists("_x.values", lambda v: (v != "-") & (v != "(NA)") & v.try_cast("double").isNull())
    r = r.select(
        *keep, F.col("_released").alias("release_date"), "problem", condition.alias("_c"), label.alias("_l"), total.alias("_total"),
        F.when(condition, "condition").when(stage.isNotNull(), "progress").alias("measure"),
        F.coalesce(F.try_element_at(stages, stage), F.regexp_replace(stage, " ", "_")).alias("stage"),
        F.when(total, "selected_states").otherwise(F.col("_x.label")).alias("region"),
        F.when(total, "selected_states").when(stage.isNotNull(), "state").alias("region_type"), values.alias("_v"), unread.alias("_unread"),
    ).filter(F.col("problem").isNotNull() | F.col("_c") | ~F.col("_l").startswith("previous "))
    wanted = F.when(F.col("_c"), len(CONDITION)).otherwise(len(COMPARISONS))
    added = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
    off = F.col("_c") & (F.abs(added - 100) > 0.01)
    r = r.withColumn("problem", F.coalesce(
        "problem", F.when(F.size("_v") != wanted, "wrong number of values").when(F.col("_unread"), "not a figure")
        .when(F.exists("_v", lambda v: ~v.between(0, 100)), "figure outside 0..100").when(F.col("_total") & off, "aggregate does not add up to 100"),
    ))
    now = F.when(F.col("_l") == "previous week", "previous_week").when(F.col("_l") == "previous year", "previous_year").otherwise("current")
    names = F.when(F.col("_c"), F.array(*[F.struct(now.alias("comparison"), F.lit(c).alias("category")) for c in CONDITION])).otherwise(
        F.array(*[F.struct(F.lit(c).alias("comparison"), F.lit("percent").alias("category")) for c in COMPARISONS])
    )
    quality = F.when(off, F.concat(F.lit("source_condition_sum_"), F.regexp_replace(added.cast("string"), r"\.0$", "")))
    columns = [*keep, "release_date", "measure", "stage", "region", "region_type"]
    out = _open(r.withColumn("_q", quality), [*columns, "_q"], F.col("problem"), F.zip_with(names, "_v", lambda a, v: F.struct(a["comparison"].alias("comparison"), a["category"].alias("category"), v.alias("value"))))
    day = F.col("release_date")
    return out.select(
        *columns, prev_sunday(day).alias("reference_date"),
        F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(16), day.cast("timestamp_ntz")).cast("timestamp"), "America/New_York").alias("available_at"),
        "_x.*", F.col("_q").alias("quality_status"), "problem",
    )


def parse_margin_text(df: DataFrame, text: str, description: str, exchange: str, prefix: str) -> DataFrame:
    """Rate blocks in free text to dated rates by roll index; a text without any is refused.

    A block is five lines: date, description, exchange, rate, and the product's prefix with its roll index.
    """
    keep = [c for c in df.columns if c != text]
    lines = df.withColumn("_lines", F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x)))

    def block(date: Column, i: Column) -> Column:
        at = [F.get("_lines", i + k) for k in range(5)]
        code = F.split(at[4], "-")
        return F.struct(
            F.when(F.length(date) == 10, F.try_to_date(date, "yyyy-MM-dd")).alias("business_date"), F.get(code, F.lit(0)).alias("product"),
            F.get(code, F.lit(1)).try_cast("int").alias("roll_index"), at[3].try_cast("double").alias("rate"),
            ((at[1] == description) & (at[2] == exchange) & (F.size(code) == 2)).alias("ours"),
        )

    found = F.filter(
        F.transform("_lines", block),
        lambda b: b["ours"] & (b["product"] == prefix) & b["business_date"].isNotNull() & b["roll_index"].isNotNull() & b["rate"].isNotNull(),
    )
    blocks = lines.withColumn("_b", found)
    rows = _open(blocks, keep, F.when(F.size("_b") == 0, "no rate rows"), F.col("_b"))
    return rows.select(*keep, "_x.business_date", "_x.product", "_x.roll_index", "_x.rate", "problem")


# ------------------------------------------------------------------ message indexes


def parse_message_index(df: DataFrame, text: str) -> DataFrame:
    """Index lines to messages; a message ends one byte before the next one starts.

    One fold over the line array finds the first fault of an index (ragged line, not a number,
    numbers that jump, offsets that do not increase, more than one run), so checking needs no
    shuffle or sort.
    """
    keep = [c for c in df.columns if c != text]
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    parsed = df.withColumn("_f", F.transform(lines, lambda x: F.split(x, ":", 7)))

    def n(x: Column, i: int) -> Column:
        return F.get(x, F.lit(i)).try_cast("bigint")

    def state(number: Column, offset: Column, run: Column, problem: Column) -> Column:
        return F.struct(number.alias("number"), offset.alias("offset"), run.alias("run"), problem.alias("problem"))

    null = F.lit(None)
    start = state(null.cast("bigint"), null.cast("bigint"), null.cast("string"), null.cast("string"))

    def step(acc: Column, x: Column) -> Column:
        number, offset, run = n(x, 0), n(x, 1), F.get(x, F.lit(2))
        fault = (
            F.when(F.size(x) != 7, "wrong number of fields").when(number.isNull() | offset.isNull(), "not a number")
            .when(number != acc["number"] + 1, "numbers jump").when(offset <= acc["offset"], "offsets not increasing")
            .when(run != acc["run"], "mixed runs")
        )
        return state(number, offset, run, F.coalesce(acc["problem"], fault))

    problem = F.when(F.size("_f") == 0, "empty index").otherwise(F.aggregate("_f", start, step, lambda acc: acc["problem"]))
    after = F.concat(F.slice("_f", F.lit(2), F.size("_f")), F.array(F.array(F.lit(None).cast("string"))))

    def message(x: Column, nxt: Column) -> Column:
        part = [F.get(x, F.lit(i)) for i in range(7)]
        return F.struct(
            n(x, 0).alias("number"), n(x, 1).alias("offset"), part[2].alias("run"), part[3].alias("variable"),
            part[4].alias("level"), part[5].alias("forecast"), part[6].alias("statistic"), (n(nxt, 1) - 1).alias("end"),
        )

    # the check above and the messages below read the same split lines
    checked = parsed.select(*keep, "_f", problem.alias("_problem"))
    return _open(checked, keep, F.col("_problem"), F.zip_with("_f", after, message)).select(*keep, "_x.*", "problem")


def select_required(msgs: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Per key and wanted (variable, level): how many messages, and ok / missing / ambiguous."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(lv).alias("level")) for v, lv in wanted])
    # One pass: a conditional count per wanted field, then a fixed unpivot.
    counts = msgs.groupBy(*keys).agg(
        *[F.sum(((F.col("variable") == v) & (F.col("level") == lv)).cast("long")).alias(f"_c{i}") for i, (v, lv) in enumerate(wanted)]
    )
    zipped = F.arrays_zip(pairs.alias("w"), F.array(*[f"_c{i}" for i in range(len(wanted))]).alias("found"))
    out = counts.select(*keys, F.inline(zipped)).select(*keys, "w.*", "found")
    return out.withColumn("status", F.when(F.col("found") == 0, "missing").when(F.col("found") > 1, "ambiguous").otherwise("ok"))


def coalesce_ranges(df: DataFrame, keys: Sequence[str], start: str, end: str, max_gap: int, bucket: int) -> DataFrame:
    """Merge ranges of a key separated by at most `max_gap` into one range.

    Ranges of a key do not overlap (they are pieces of one object). Merging runs inside
    (key, bucket of start), so a very long object is spread over its buckets; only the first
    and last island of each bucket can touch a neighbour, and just those meet per key.
    """
    keys = list(keys)

    def islands(rows: DataFrame, part: list[str], s: str, e: str, n: Column, extra: Sequence[Column] = ()) -> DataFrame:
        w = W.partitionBy(*part).orderBy(s, e)
        gap = F.col(s) - F.lag(e).over(w) - 1
        run = F.sum(F.when(gap <= max_gap, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("_i", run).groupBy(*part, "_i").agg(F.min(s).alias("_s"), F.max(e).alias("_e"), n.alias("_n"), *extra)

    local = df.withColumn("_b", F.floor(F.col(start) / F.lit(bucket)))
    local = islands(local, [*keys, "_b"], start, end, F.count(F.lit(1)))
    last = local.groupBy(*keys, "_b").agg(F.max("_i").alias("_last"))
    local = local.join(last, [*keys, "_b"]).withColumn("_edge", (F.col("_i") == 1) | (F.col("_i") == F.col("_last")))
    inner = local.filter(~F.col("_edge")).select(*keys, "_s", "_e", "_n")
    edges = local.filter("_edge").select(*keys, "_s", "_e", F.col("_n").alias("_c"))
    merged = islands(edges.withColumnRenamed("_s", "_s0").withColumnRenamed("_e", "_e0"), keys, "_s0", "_e0", F.sum("_c"))
    both = inner.unionByName(merged.select(*keys, "_s", "_e", "_n"))
    return both.select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_n").alias("pieces"))


# ------------------------------------------------------------------ links


def resolved(href: Column, url: Column) -> Column:
    """The absolute target of a link on a page."""
    scheme = F.substring_index(url, "://", 1)
    rest = F.regexp_replace(url, r"^[^:/]+://", "")
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, r"^[^/?#]*", 0))
    page = F.regexp_replace(url, r"[?#].*$", "")
    folder = F.when(F.regexp_replace(rest, r"[?#].*$", "").contains("/"), F.regexp_replace(page, r"[^/]*$", "")).otherwise(F.concat(page, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(url, "#.*$", ""), href)).when(href == "", url).otherwise(F.concat(folder, href))
    )


def host_of(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_links(df: DataFrame, html: str, url: str, pattern: str, hosts: Sequence[str]) -> DataFrame:
    """Anchors of a page: absolute target, label, host, and whether the host is one of `hosts`, exactly.

    `pattern` has (href, label) groups.
    """
    keep = [c for c in df.columns if c not in (html, url)]
    links = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("_h"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("_l"),
    )
    rows = df.select(*keep, F.col(url).alias("_url"), F.inline(links))
    out = rows.select(*keep, resolved(F.col("_h"), F.col("_url")).alias("href"), F.trim(F.regexp_replace("_l", r"\s+", " ")).alias("label"))
    out = out.withColumn("host", host_of(F.col("href")))
    return out.withColumn("allowed", F.col("host").isin(*[h.lower() for h in hosts]))


def typed_links(links: DataFrame, keys: Sequence[str], label_pattern: str, date_format: str, suffix: str) -> DataFrame:
    """Releases of each page by date: links with a dated label and the wanted file type.

    Group 1 of `label_pattern` is the date. A release on a host that is not allowed, or a date with
    more than one target, is a problem of that release.
    """
    path = F.lower(F.regexp_replace("href", r"[?#].*$", ""))
    text = F.regexp_replace(F.regexp_extract("label", label_pattern, 1), r"\s+", " ")
    dated = links.filter((text != "") & path.endswith(suffix)).withColumn("release_date", F.try_to_date(text, date_format))
    per_date = dated.groupBy(*keys, "release_date").agg(
        F.min("href").alias("href"), F.max("href").alias("_other"), F.min(F.col("allowed").cast("int")).alias("_ok")
    )
    problem = F.when(F.col("release_date").isNull(), "unreadable date").when(F.col("_ok") == 0, "host not allowed").when(F.col("href") != F.col("_other"), "more than one target")
    return per_date.select(*keys, "release_date", "href", problem.alias("problem"))


def last_page(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest page number that a page links to; 0 where it links to none."""
    return links.groupBy(*keys).agg(F.coalesce(F.max(page_number("href")), F.lit(0)).alias("last_page"))


def link_conflicts(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of a page that point at more than one target."""
    return links.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("links"), (F.min("href") != F.max("href")).alias("conflict")
    )


def page_number(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"[?&]page=(\d+)", 1).try_cast("int")


# ------------------------------------------------------------------ vendor exports


def import_export(
    df: DataFrame, columns: Mapping[str, str], root: str, root_values: Mapping[str, str], prices: Sequence[str], multiplier: float
) -> DataFrame:
    """Vendor columns through an explicit mapping; a root value the mapping lacks is an error row."""
    missing = sorted(set(columns.values()) - set(df.columns))
    if missing:
        raise ValueError(f"export is missing mapped columns: {missing}")
    picked = df.select(*[F.col(v).alias(k) for k, v in columns.items()])
    lookup = F.create_map(*[F.lit(x) for kv in root_values.items() for x in kv])
    found = F.try_element_at(lookup, F.trim(F.col(root)))
    marked = picked.withColumn("problem", F.when(found.isNull(), "unmapped root"))
    out = marked.withColumn(root, F.coalesce(found, F.col(root)))
    for p in prices:
        out = out.withColumn(f"{p}_cents", F.when(F.col("problem").isNull(), F.col(p).cast("double") * multiplier)).drop(p)
    return out


def normalize_history(df: DataFrame, expiry: str, o: str, h: str, lo: str, s: str) -> DataFrame:
    """Numeric YYYYMMDD expiry to a date, and why a bar would be dropped (NULL = kept)."""
    out = df.withColumn(expiry, F.try_to_date(F.regexp_replace(F.col(expiry).cast("string"), r"\.0$", ""), "yyyyMMdd"))
    incomplete = F.lit(False)
    for c in (expiry, o, h, lo, s):
        incomplete = incomplete | F.col(c).isNull()
    impossible = (F.col(h) < F.col(o)) | (F.col(lo) > F.col(o)) | (F.col(lo) > F.col(h))
    return out.withColumn("dropped", F.when(incomplete, "incomplete").when(impossible, "impossible"))


# ------------------------------------------------------------------ outlooks and forecasts


def normalise_outlooks(
    polys: DataFrame, files: DataFrame, leads: Mapping[str, tuple[int, int]]
) -> DataFrame:
    """Two schema eras to one, plus a Normal row for every file without polygons.

    unified rows carry cat/prob and start/end dates; early rows carry a text label and one
    combined period, and take their category from the file. A file with no polygon is a
    forecast of climatological odds, dated from its issue date and the product's leads.
    """
    from tidemark.functions.scalar import signed_anomaly

    per = F.split("valid_period", r"\s*-\s*")
    early = F.col("prob").isNull()
    rows = polys.join(files, "file_id")
    rows = rows.select(
        "file_id", "product", "issued",
        F.when(early, F.try_to_date(per[0], "MM/dd/yyyy")).otherwise(F.col("start")).alias("valid_start"),
        F.when(early, F.try_to_date(F.get(per, F.lit(1)), "MM/dd/yyyy")).otherwise(F.col("end")).alias("valid_end"),
        F.when(early, F.col("file_category")).otherwise(F.col("cat")).alias("category"),
        F.when(early, F.trim("label").try_cast("double")).otherwise(F.col("prob")).alias("probability"),
        F.when(early, "early").otherwise("unified").alias("era"),
    )
    lo = F.create_map(*[F.lit(x) for k, v in leads.items() for x in (k, v[0])])
    hi = F.create_map(*[F.lit(x) for k, v in leads.items() for x in (k, v[1])])
    empty = files.join(polys.select("file_id").distinct(), "file_id", "left_anti").select(
        "file_id", "product", "issued",
        F.date_add("issued", lo[F.col("product")]).alias("valid_start"), F.date_add("issued", hi[F.col("product")]).alias("valid_end"),
        F.lit("Normal").alias("category"), F.lit(None).cast("double").alias("probability"), F.lit("empty").alias("era"),
    )
    both = rows.unionByName(empty)
    # No polygon means climatological odds: a zero anomaly, not a missing one.
    return both.withColumn(
        "anomaly", F.when(F.col("category") == "Normal", 0.0).otherwise(signed_anomaly("probability", "category"))
    )


def filter_verified(df: DataFrame, archived: str, available: str, lead: str, expected: str) -> DataFrame:
    """Rows archived by their availability whose lead is the manifest's have no problem; the rest name it."""
    problem = F.when(F.col(archived) > F.col(available), "archived late").when(F.col(lead) != F.col(expected), "wrong lead")
    return df.withColumn("problem", problem)


def geo_dims(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Members with weights normalised per key; equal weights where none are configured."""
    total = df.groupBy(*keys).agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_n"))
    has = F.col("_t").isNotNull() & (F.col("_t") > 0)
    share = F.when(has, F.coalesce(F.col(weight), F.lit(0.0)) / F.col("_t")).otherwise(F.lit(1.0) / F.col("_n"))
    return df.join(total, list(keys)).withColumn("share", share).drop("_t", "_n")
