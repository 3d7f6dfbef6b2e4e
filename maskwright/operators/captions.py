"""Captions, question-answer lists and titles from class statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import AREA_WORDS, CAPTION, CELLS, ERROR_QUESTION, FAMILIES, LINES, NO_CELL, NO_ERROR, QA, QUALIFIED, REGIONS, TITLE


def names_map(names: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in names.items() for x in p])


def id_captions(ids: DataFrame, names: dict[int, str], language: str = "zh", with_area: bool = True, background_as_class0: bool = True) -> DataFrame:
    """img, caption from rows (img, k[, area]) in class order; an image without a nameable class gets the fixed sentence; an unknown id raises."""
    t = CAPTION[language]
    label = names_map(names)[F.col("k")]
    label = F.when(label.isNull(), F.raise_error(F.concat(F.lit("unknown class "), F.col("k").cast("string"))).cast("string")).otherwise(label)
    said = label
    if with_area:
        said = F.when(F.col("area") > 0.3, F.concat(F.lit(t["large"]), label)).when(F.col("area") > 0.001, F.concat(F.lit(t["small"]), label))
    if background_as_class0:
        said = F.when(F.col("k") != 0, said)
    parts = F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("k", said.alias("said")))))
    text = F.array_join(F.transform("parts", lambda x: x["said"]), t["join"])
    return ids.groupBy("img").agg(parts.alias("parts")).select("img", F.when(F.size("parts") == 0, F.lit(t["none"])).otherwise(F.concat(F.lit(t["start"]), text, F.lit(t["end"]))).alias("caption"))


def caption_ids(captions: DataFrame, label2id: dict[str, int]) -> DataFrame:
    """The rows with label_names and category_ids: vocabulary names that the caption contains, in vocabulary order; none for a qualified image."""
    vocab = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i in label2id.items()])
    found = F.when(F.contains(F.col("caption"), F.lit(QUALIFIED)), F.slice(vocab, 1, 0)).otherwise(F.filter(vocab, lambda x: F.contains(F.col("caption"), x["n"])))
    return captions.withColumn("_f", found).withColumn("label_names", F.transform("_f", lambda x: x["n"])).withColumn("category_ids", F.transform("_f", lambda x: x["i"])).drop("_f")


def error_captions(rows: DataFrame, translate: dict[str, str], column: str = "错误描述", need_question: bool = False) -> DataFrame:
    """``caption``: the known errors translated, distinct, sorted and joined; ``no error`` for none."""
    known = F.create_map(*[F.lit(x) for p in translate.items() for x in p])
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: known[x]), lambda x: x.isNotNull())))
    text = F.when(F.size(found) == 0, F.lit(NO_ERROR)).otherwise(F.array_join(found, ", "))
    return rows.withColumn("caption", F.concat(F.lit(ERROR_QUESTION), text) if need_question else text)


def question_prefix(caption: Column) -> Column:
    """The question of a caption: all before the first ``"? "``, with its mark."""
    return F.concat(F.split_part(caption, F.lit("? "), F.lit(1)), F.lit("?"))


def region_title(region: Column, problem: str = "拼接错误") -> Column:
    """The sentence that says where a dividing line is."""
    pick = lambda names: F.get(F.array(*map(F.lit, names)), region)
    return F.concat(F.lit(TITLE[0] + problem + TITLE[1]), pick(REGIONS), F.lit(TITLE[2]), pick(LINES), F.lit(TITLE[3]))


def attribute_answers(attributes: DataFrame, names: dict[int, str]) -> DataFrame:
    """img, pos, question, answer: one overall question (pos 0), then one for each attribute row.

    ``attributes``: img, k, area, num, area_cell, centre_cell, w, h; cells are ids
    from 0 to 8 or null.
    """
    q, cell = QA, lambda c: F.coalesce(F.get(F.array(*map(F.lit, CELLS)), F.col(c)), F.lit(NO_CELL))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    label, area = F.col("label"), F.col("area")
    word = F.lit(None).cast("string")
    for least, text in reversed(AREA_WORDS):
        word = F.when(area > least, F.lit(text)).otherwise(word)
    there = F.when(area > AREA_WORDS[-2][0], F.lit(q["there"])).otherwise(F.lit(q["maybe"]))
    in_area = F.when(area > AREA_WORDS[0][0], say(q["all"], label, q["stop"])).otherwise(say(there, F.when(F.col("num") > 1, q["many"]).otherwise(q["one"]), word, label, q["mostly"], cell("area_cell")))
    in_seam = say(q["there"], q["seam"], label, q["seam_trace"], cell("centre_cell"), q["seam_is"], F.when(F.col("w") > F.col("h"), q["across"]).otherwise(q["upright"]), q["seam_end"])
    in_pixel = say(q["there"], F.col("num").cast("string"), q["places"], label, q["mostly"], cell("area_cell"), q["stop"])
    unknown = F.raise_error(F.concat(F.lit("no family of labels has "), label)).cast("string")
    answer = F.when(area == 0, say(q["absent"], label, q["stop"])).when(label.isin(FAMILIES["area"]), in_area).when(label.isin(FAMILIES["seam"]), in_seam).when(label.isin(FAMILIES["pixel"]), in_pixel).otherwise(unknown)
    name = names_map(names)[F.col("k")]
    rows = attributes.withColumn("label", F.when(name.isNull(), F.raise_error(F.lit("unknown class")).cast("string")).otherwise(name))
    each = rows.select("img", "k", "label", "area", F.struct(F.lit(0).alias("pos"), say(q["ask"], label, q["ask_end"]).alias("question"), answer.alias("answer")).alias("qa"))
    image = each.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("k", "label", "area", "qa"))).alias("x"))
    seen = F.transform(F.filter("x", lambda x: x["area"] != 0), lambda x: x["label"])
    nothing = F.forall(seen, lambda n: n == names[0])
    overall = F.when(nothing, F.lit(q["overall_no"])).otherwise(F.concat(F.lit(q["overall_yes"]), F.array_join(seen, q["list"]), F.lit(q["stop"])))
    first = F.array(F.struct(F.lit(q["overall"]).alias("question"), overall.alias("answer")))
    rest = F.transform("x", lambda x: F.struct(x["qa"]["question"].alias("question"), x["qa"]["answer"].alias("answer")))
    return image.select("img", F.posexplode(F.concat(first, rest)).alias("pos", "qa")).select("img", "pos", "qa.question", "qa.answer")


def join_names(names: Sequence[Column], sep: str) -> Column:
    return F.array_join(F.array(*names), sep)
