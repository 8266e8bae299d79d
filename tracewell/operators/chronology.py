"""Dated core sequences: ordering, selection, context segments, divergences.

A candidate is in the dated core if it is a core occurrence with a usable date.
The judgment of an adjacent pair is given as a table (inv, from_id, to_id, same,
different) in whole percents; a pair without one is unexamined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import let
from .policy import STRONG, UNRESOLVED, flags

MOST_SELECTED = 8


#: Windows of examined() keep the dated core apart from an investigation's other rows.
APART = ("inv", "eligible")


def _in_core() -> Column:
    """Whether a row is of the dated core; needs core."""
    dated = (F.col("date_status") == "usable") & F.col("published_at").isNotNull() & (F.col("precision") != "unknown")
    return F.coalesce(dated & F.col("core"), F.lit(False))


def _placed(rows: DataFrame, part: tuple[str, ...] = ("inv",)) -> DataFrame:
    value, precision = F.col("published_at"), F.col("precision")
    rows = rows.withColumn("day_start", dates.day_start(value, precision)).withColumn("day_end", dates.day_end(value, precision))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*part).orderBy("day_start", "day_end", "cand_id")))


def dated_core(candidates: DataFrame) -> DataFrame:
    """The dated core, with day_start, day_end and pos, its place in chronological order from 1."""
    return _placed(flags(candidates).where(_in_core()))


def roles(candidates: DataFrame) -> DataFrame:
    """(inv, cand_id, bucket): dated core, dated lead, dated contextual or undated."""
    return _with_bucket(candidates).select("inv", "cand_id", "bucket")


def _with_bucket(candidates: DataFrame) -> DataFrame:
    dated = (F.col("date_status") == "usable") & (F.col("precision") != "unknown") & F.col("published_at").isNotNull()
    bucket = (
        F.when(~F.coalesce(dated, F.lit(False)), "undated")
        .when(F.col("core"), "dated_core")
        .when(F.col("relationship") == "VISUAL_LEAD", "dated_lead")
        .otherwise("dated_contextual")
    )
    return flags(candidates).withColumn("bucket", bucket)


def context_label(same: Column, different: Column, historical: Column) -> Column:
    """The context of a candidate; different is looked at first, then same, then historical."""
    return (
        F.when(F.coalesce(different, F.lit(0)) >= STRONG, "different_context")
        .when(F.coalesce(same, F.lit(0)) >= STRONG, "same_context")
        .when(F.coalesce(historical, F.lit(0)) >= STRONG, "historical")
        .otherwise("unclear")
    )


def pair_class(same: Column, different: Column) -> Column:
    """Class of a judged pair; null judgments are unexamined."""
    return (
        F.when(different.isNull() & same.isNull(), "unexamined")
        .when(different >= STRONG, "different_context")
        .when(same >= STRONG, "same_context")
        .otherwise("uncertain")
    )


def select_occurrences(dated: DataFrame, most: int = MOST_SELECTED) -> DataFrame:
    """At most ``most`` rows of each dated core: earliest, latest, then the earliest of highest novelty, again and again.

    The rounds run within a list of those rows of an investigation that can be
    picked at all, some 130 at most, whatever its size (_pickable); a domain or
    group that is missing is like no other.
    """
    c, inv = F.col, Window.partitionBy("inv")
    own = F.concat(F.lit("\0"), c("pos").cast("string"))
    key = F.when(c("origin_status") != UNRESOLVED, F.coalesce("grp", own)).otherwise("")
    rows = dated.withColumn("last", c("pos") == F.max("pos").over(inv))
    row = F.struct("pos", F.coalesce("domain", own).alias("domain"), key.alias("key"), F.struct(*[c(n) for n in dated.columns if n not in ("inv", "pos")]).alias("row"))
    rows = _pickable(rows.select("inv", row.alias("r"), "last").select("inv", "r.*", "last"), most)
    pool = rows.groupBy("inv").agg(F.array_sort(F.collect_list(F.struct("pos", "domain", "key", "row"))).alias("rows"), F.max("pos").alias("n"))
    few = F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), r["domain"].alias("domain"), r["key"].alias("key")))

    def pick(picked: Column, _: Column) -> Column:
        def of(picked: Column) -> Column:
            held = lambda name, value: F.exists(picked, lambda p: p[name] == value)
            less = lambda r: -(~held("domain", r["domain"])).cast("int") - ((r["key"] != "") & ~held("key", r["key"])).cast("int")
            left = F.filter("few", lambda r: ~held("pos", r["pos"]))
            best = F.array_min(F.transform(left, lambda r: F.struct(less(r).alias("less"), r.alias("r"))))
            return F.concat(picked, F.array(best["r"]))

        return let(picked, of)

    ends = F.filter("few", lambda r: (r["pos"] == 1) | (r["pos"] == c("n")))
    pool = pool.withColumn("few", few)
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(most - 2)), ends, pick) if most > 2 else ends
    pool = pool.withColumn("picked", F.when(c("n") > most, F.transform(rounds, lambda p: p["pos"])))
    taken = F.filter("rows", lambda r: c("picked").isNull() | F.array_contains("picked", r["pos"]))
    return pool.select("inv", F.explode(taken).alias("r")).select("inv", "r.pos", "r.row.*").select(*dated.columns)


def _pickable(rows: DataFrame, most: int) -> DataFrame:
    """The rows (inv, pos, domain, key, last) that select_occurrences() can pick; key is empty where a row has no resolved group.

    Before any pick under ``most`` rows are picked, so that under ``most`` domains
    and groups are known. What is not new at all is the earliest row that is left:
    one of the first ``most``. Other rows are the first of their domain and group,
    as all of those are equally novel. If none is new in both, the pick is the
    first row of a new domain or group: of the first ``most`` to appear. Of those
    new in both, a domain's earlier rows have known groups, and a group's have
    known domains: so it is among the first ``most`` of each, and, of all such
    rows, all before it are of known domains and groups, 2 * (most - 1) * most at most.
    """
    c = F.col
    over = lambda *part: F.row_number().over(Window.partitionBy("inv", *part).orderBy(~c("first"), "pos"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("inv", "domain", "key").orderBy("pos")) == 1)
    rows = rows.withColumn("keep", (c("pos") <= most) | c("last")).where("first OR keep")
    rows = rows.withColumn("in_domain", F.when(c("first"), over("domain"))).withColumn("in_key", F.when(c("first"), over("key")))
    kinds = ((c("in_domain") == 1, most), (c("in_key") == 1, most), ((c("in_domain") <= most) & (c("in_key") <= most), 2 * (most - 1) * most + 1))
    so_far = Window.partitionBy("inv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    able = [F.coalesce(of, F.lit(False)) & (F.count_if(of).over(so_far) <= n) for of, n in kinds]
    return rows.withColumn("able", able[0] | able[1] | able[2]).where("keep OR able")


def connect(selected: DataFrame, judgments: DataFrame) -> DataFrame:
    """Adds from_id, connector, break and change to each selected row, against the row before it.

    The first row of a sequence has connector "start". Rows whose interval is not
    wholly after the earlier row's are unexamined, whatever the judgment.
    """
    judged = judgments.select(
        "inv", "from_id", F.col("to_id").alias("cand_id"), F.col("same").alias("pair_same"), F.col("different").alias("pair_different")
    )
    return _connectors(_after(selected).join(judged, ["inv", "from_id", "cand_id"], "left"))


def connect_own(selected: DataFrame, same: Column, different: Column, part: tuple[str, ...] = ("inv",)) -> DataFrame:
    """connect() where each row has the judgment of its own pair with the row before it, so that no table of judgments is joined."""
    return _connectors(_after(selected, part).withColumn("pair_same", same).withColumn("pair_different", different))


def _after(selected: DataFrame, part: tuple[str, ...] = ("inv",)) -> DataFrame:
    order = Window.partitionBy(*part).orderBy("pos")
    return selected.withColumn("from_id", F.lag("cand_id").over(order)).withColumn("from_end", F.lag("day_end").over(order))


def _connectors(rows: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("from_id").isNull(), "start")
        .when(~(F.col("from_end") < F.col("day_start")), "unexamined")
        .otherwise(pair_class(F.col("pair_same"), F.col("pair_different")))
    )
    rows = rows.withColumn("connector", kind)
    return rows.withColumn("change", (F.col("connector") == "different_context").cast("int")).withColumn(
        "break", F.col("connector").isin("unexamined", "uncertain").cast("int")
    )


def segments(connected: DataFrame, part: tuple[str, ...] = ("inv",)) -> DataFrame:
    """Adds segment: the number of changes so far, or null once continuity broke until the next change."""
    order = Window.partitionBy(*part).orderBy("pos")
    rows = connected.withColumn("run", F.sum("change").over(order))
    broken = F.sum("break").over(Window.partitionBy(*part, "run").orderBy("pos"))
    return rows.withColumn("segment", F.when(broken == 0, F.col("run")))


def examined(candidates: DataFrame, same: Column, different: Column) -> DataFrame:
    """Every row with eligible and, for those of the dated core, connector, break, change, run and segment; else these are null.

    The whole dated core is selected, and each row has the judgment of its own
    pair, as in connect_own(). One pass over the rows: nothing is joined.
    """
    rows = _placed(flags(candidates).withColumn("eligible", _in_core()), APART)
    rows = segments(connect_own(rows, same, different, APART), APART)
    return rows.withColumns({n: F.when(F.col("eligible"), F.col(n)) for n in ("connector", "break", "change", "run", "segment")})


def first_divergence() -> Column:
    """Aggregate of rows of examined() with breaks_so_far: struct(from_id, to_id, observed_at, earlier_unresolved) of the first change."""
    c = F.col
    row = F.struct("from_id", c("cand_id").alias("to_id"), c("published_at").alias("observed_at"), (c("breaks_so_far") > 0).alias("earlier_unresolved"))
    return F.min_by(row, F.when(c("change") == 1, c("pos")))


def breaks_so_far(rows: DataFrame) -> DataFrame:
    return rows.withColumn("breaks_so_far", F.sum("break").over(Window.partitionBy(*APART).orderBy("pos")))


def segment_counts(segmented: DataFrame, dated: DataFrame) -> DataFrame:
    """(inv, eligible, selected, compared, n_segments): n_segments is null unless all eligible rows are selected and every pair is decided."""
    eligible = dated.groupBy("inv").agg(F.count(F.lit(1)).alias("eligible"))
    own = segmented.groupBy("inv").agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(F.col("connector").isin("same_context", "different_context", "uncertain")).alias("compared"),
        F.max("run").alias("last"),
        F.sum("break").alias("breaks"),
    )
    whole = (F.col("selected") == F.col("eligible")) & (F.col("breaks") == 0)
    return eligible.join(own, "inv").select("inv", "eligible", "selected", "compared", F.when(whole, F.col("last") + 1).alias("n_segments"))


def divergences(segmented: DataFrame) -> DataFrame:
    """(inv, from_id, to_id, observed_at, first_observed, earlier_unresolved) of each change of context.

    Earlier transitions are unresolved after any break, and where an eligible row
    before was not selected: then the row's place among the eligible exceeds its
    place among the selected.
    """
    order = Window.partitionBy("inv").orderBy("pos")
    rows = segmented.withColumn("place", F.row_number().over(order)).withColumn("breaks", F.sum("break").over(order))
    rows = rows.where("change = 1").withColumn("nth", F.row_number().over(order))
    return rows.select(
        "inv",
        "from_id",
        F.col("cand_id").alias("to_id"),
        F.col("published_at").alias("observed_at"),
        (F.col("nth") == 1).alias("first_observed"),
        ((F.col("breaks") > 0) | (F.col("pos") > F.col("place"))).alias("earlier_unresolved"),
    )


def timeline(candidates: DataFrame, segmented: DataFrame) -> DataFrame:
    """(inv, cand_id, bucket, connector, segment): every row; those outside the examined run are unexamined."""
    run = segmented.select("inv", "cand_id", "connector", "segment")
    return _timeline(_with_bucket(candidates).select("inv", "cand_id", "bucket").join(run, ["inv", "cand_id"], "left"))


def timeline_of(rows: DataFrame) -> DataFrame:
    """timeline() of rows of examined(), without a join."""
    return _timeline(_with_bucket(rows))


def _timeline(rows: DataFrame) -> DataFrame:
    return rows.select("inv", "cand_id", "bucket", F.coalesce("connector", F.lit("unexamined")).alias("connector"), "segment")


def graph_nodes(segmented: DataFrame) -> DataFrame:
    """(inv, node_kind, node, n_members): domain and segment nodes of the provenance graph."""
    node = lambda kind, name: F.struct(F.lit(kind).alias("node_kind"), F.col(name).cast("string").alias("node"))
    nodes = F.array_compact(F.array(node("domain", "domain"), F.when(F.col("segment").isNotNull(), node("segment", "segment"))))
    rows = segmented.select("inv", F.explode(nodes).alias("n")).select("inv", "n.*")
    return rows.groupBy("inv", "node_kind", "node").agg(F.count(F.lit(1)).alias("n_members"))


def claim_comparisons(candidates: DataFrame, segmented: DataFrame) -> DataFrame:
    """(inv, cand_id, segment, question, answer): a row for each claim question that a core row answers strongly."""
    rows = flags(candidates).where("core AND relevant").join(segmented.select("inv", "cand_id", "segment"), ["inv", "cand_id"], "left")
    return claim_answers(rows)


def claim_answers(rows: DataFrame) -> DataFrame:
    """claim_comparisons() of rows with their segment, such as relevant core rows of examined()."""
    claim = F.when(F.col("contradicts") >= STRONG, "contradicts").when(F.col("supports") >= STRONG, "supports")
    place = F.when(F.col("loc_different") >= STRONG, "different_location")
    each = F.array(
        F.struct(F.lit("claim").alias("question"), claim.alias("answer")), F.struct(F.lit("location").alias("question"), place.alias("answer"))
    )
    return rows.select("inv", "cand_id", "segment", F.explode(each).alias("q")).select("inv", "cand_id", "segment", "q.*").where("answer IS NOT NULL")
