"""Scoring predictions against gold tables of string cells, field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The fields' kinds.
YESNO = ["alb", "sch", "hai", "grassland", "forest", "aboveground", "belowground", "field", "laboratory", "review", "rex1", "rex2", "lux", "fox"]
MULTILABEL = ["plot_level", "keywords", "biotic_data_taxon", "biotic_data_type", "processes_and_services", "environmental_descriptors", "project", "content_type", "infrastructure"]
FUZZY = ["sampling_design", "sampling_preparation", "sample_analysis", "equipment", "data_preparation", "data_analysis", "experimental_manipulation", "temporal_repetitions", "plot_repetitions", "study_design"]
NUMERIC = ["number_of_gp", "number_of_ep", "number_of_mip", "number_of_vip"]



def autodetect_id(columns: list[str]) -> str:
    """id, Id or ID, else the first column."""
    return next((c for c in ("id", "Id", "ID") if c in columns), columns[0])


def parse_renames(arg: str) -> dict[str, str]:
    """``old:new,old2:new2`` as a mapping; parts without a colon or with a blank side are skipped."""
    pairs = (part.split(":", 1) for part in arg.split(",") if ":" in part)
    return {a.strip(): b.strip() for a, b in pairs if a.strip() and b.strip()}


def last_wins(df: DataFrame, id_col: str, order: str | None = None) -> DataFrame:
    """One row per trimmed id, the last one in the order given; rows without an id go."""
    rows = df.withColumn("_id", F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).where("_id <> ''")
    at = F.col(order) if order else F.monotonically_increasing_id()
    picked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(at.desc())))
    return picked.where("_n = 1").withColumn(id_col, F.col("_id")).drop("_id", "_n")


def kinds(pred: list[str], gold: list[str], skip: tuple[str, ...] = ("id", "Id", "ID"), yesno: list[str] | None = None, multilabel: list[str] | None = None, fuzzy: list[str] | None = None, numeric: list[str] | None = None) -> dict[str, list[str]]:
    """The overlapping columns by kind; given lists are cut to the overlap, what is left is multilabel."""
    both = sorted(set(pred) & set(gold) - set(skip))
    chosen = {k: [f for f in (given if given is not None else known) if f in both] for k, given, known in (("yesno", yesno, YESNO), ("numeric", numeric, NUMERIC), ("fuzzy", fuzzy, FUZZY))}
    taken = {f for fields in chosen.values() for f in fields}
    chosen["multilabel"] = [f for f in (multilabel if multilabel is not None else both) if f in both and f not in taken]
    return chosen


def aligned(pred: DataFrame, gold: DataFrame, fields: list[str], pred_id: str, gold_id: str) -> DataFrame:
    """id, field, p, g: cells of the ids on both sides, long."""
    stack = lambda df, key, side: df.select(F.col(key).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(side)) for f in fields])))
    return stack(pred, pred_id, "p").join(stack(gold, gold_id, "g"), ["id", "field"])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def yesno(cells: DataFrame, drop_ignored: bool = False) -> DataFrame:
    """Confusion counts and rates by field; an unclear prediction counts against the gold (fn for yes, tn for no)."""
    rows = cells.select("field", T.parse_yesno(F.col("p"), drop_ignored).alias("p"), T.parse_yesno(F.col("g"), drop_ignored).alias("g")).where(F.col("g").isin("yes", "no"))
    n = rows.groupBy("field").agg(
        _count((F.col("g") == "yes") & (F.col("p") == "yes")).alias("tp"),
        _count((F.col("g") == "no") & (F.col("p") == "yes")).alias("fp"),
        _count((F.col("g") == "yes") & (F.col("p") != "yes")).alias("fn"),
        _count((F.col("g") == "no") & (F.col("p") != "yes")).alias("tn"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return n.select("field", F.lit("yesno").alias("type"), total.alias("support"), ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), "tp", "fp", "fn", "tn")


def multilabel(cells: DataFrame, drop_ignored: bool = False) -> DataFrame:
    """Micro rates, subset accuracy and mean Jaccard by field; two empty cells match."""
    p, g = T.split_multivalue(F.col("p"), drop_ignored), T.split_multivalue(F.col("g"), drop_ignored)
    rows = cells.select("field", p.alias("p"), g.alias("g")).select("field", F.size(F.array_intersect("p", "g")).alias("i"), F.size(F.array_except("p", "g")).alias("fp"), F.size(F.array_except("g", "p")).alias("fn"))
    union = F.col("i") + F.col("fp") + F.col("fn")
    n = rows.groupBy("field").agg(F.sum("i").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")).alias("subset_accuracy"), F.avg(F.when(union == 0, 1.0).otherwise(F.col("i") / union)).alias("avg_jaccard"), F.count("*").alias("support"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("field", F.lit("multilabel").alias("type"), "support", p.alias("micro_precision"), r.alias("micro_recall"), f1.alias("micro_f1"), "subset_accuracy", "avg_jaccard")


def fuzzy(cells: DataFrame, threshold: float = 0.85, drop_ignored: bool = False) -> DataFrame:
    """Micro rates and mean soft Jaccard (matches over the longer list; two empty lists: 0) by field."""
    rows = cells.select("field", T.split_multivalue(F.col("p"), drop_ignored).alias("p"), T.split_multivalue(F.col("g"), drop_ignored).alias("g"))
    rows = rows.withColumn("m", T.greedy_pairs(F.col("p"), F.col("g"), threshold))
    rows = rows.select("field", F.size("m").alias("tp"), F.size("p").alias("np"), F.size("g").alias("ng"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x["sim"]).alias("sims"))
    n = rows.groupBy("field").agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("ng") - F.col("tp")).alias("fn"), F.avg(ratio(F.col("tp"), F.greatest("np", "ng"))).alias("avg_soft_jaccard"), F.count("*").alias("support"), F.sum("sims").alias("sims"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("field", F.lit("fuzzy-list").alias("type"), "support", p.alias("micro_precision"), r.alias("micro_recall"), f1.alias("micro_f1"), "avg_soft_jaccard", ratio(F.col("sims"), F.col("tp")).alias("avg_match_similarity"))


def to_int(c: Column) -> Column:
    """A cell as a number cut to an integer; null where it is none."""
    return T.strip(c).try_cast("double").try_cast("long")


def numeric(cells: DataFrame) -> DataFrame:
    """Exact rate, mean absolute and root mean square error over the pairs that are numbers."""
    rows = cells.select("field", to_int(F.col("p")).alias("p"), to_int(F.col("g")).alias("g"))
    d = F.col("p") - F.col("g")
    n = rows.groupBy("field").agg(F.count(d).alias("support"), F.avg(F.when(d.isNotNull(), (d == 0).cast("int"))).alias("exact_match"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return n.select("field", F.lit("numeric").alias("type"), "support", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("exact_match", "mae", "rmse")])


def freetext(cells: DataFrame) -> DataFrame:
    """Mean ROUGE-L over the pairs that are not both blank."""
    rows = cells.where((T.norm_text(F.col("p")) != "") | (T.norm_text(F.col("g")) != "")).select("field", T.rouge_l(F.col("p"), F.col("g")).alias("s"))
    return rows.groupBy("field").agg(F.count("*").alias("support"), F.avg("s.p").alias("rougeL_p"), F.avg("s.r").alias("rougeL_r"), F.avg("s.f1").alias("rougeL_f1")).withColumn("type", F.lit("free-text"))


def evaluate(pred: DataFrame, gold: DataFrame, *, rename_pred: str = "", rename_gold: str = "", pred_id: str | None = None, gold_id: str | None = None, threshold: float = 0.85, drop_ignored: bool = False, freetext_fields: list[str] | None = None, **lists: list[str]) -> DataFrame:
    """One wide summary row per field, nulls where a measure doesn't apply.

    Ids and columns are taken after renaming; the cells are read once for all fields of a kind.
    """
    pred, gold = pred.withColumnsRenamed(parse_renames(rename_pred)), gold.withColumnsRenamed(parse_renames(rename_gold))
    pred_id, gold_id = pred_id or autodetect_id(pred.columns), gold_id or autodetect_id(gold.columns)
    by = kinds(pred.columns, gold.columns, (pred_id, gold_id), **lists)
    by["freetext"] = [f for f in freetext_fields or [] if f in pred.columns and f in gold.columns]
    measures = {"yesno": lambda c: yesno(c, drop_ignored), "numeric": numeric, "fuzzy": lambda c: fuzzy(c, threshold, drop_ignored), "multilabel": lambda c: multilabel(c, drop_ignored), "freetext": freetext}
    parts = [measures[k](aligned(pred, gold, fields, pred_id, gold_id)) for k, fields in by.items() if fields]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def confusion(scores: DataFrame, field: str) -> DataFrame:
    """The 2 x 2 table of a yes/no field: predicted, gold_yes, gold_no."""
    row = scores.where(F.col("field") == field)
    return row.select(F.inline(F.array(F.struct(F.lit("pred_yes").alias("predicted"), F.col("tp").alias("gold_yes"), F.col("fp").alias("gold_no")), F.struct(F.lit("pred_no").alias("predicted"), F.col("fn").alias("gold_yes"), F.col("tn").alias("gold_no")))))
