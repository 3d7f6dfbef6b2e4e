"""Label vocabularies, positions and sentence templates.

Fixed values: the names and sentences below are output formats and model
vocabularies, so they are stated as they must appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: label names by id, for each vocabulary
VOCABULARIES: dict[str, dict[int, str]] = {
    "qa": {0: "背景", 1: "云", 2: "阴影", 3: "拉花", 4: "拼接痕迹", 5: "拼接错误", 6: "扭曲", 7: "模糊", 8: "光谱溢出", 9: "条状噪声", 10: "像素缺失"},
    "classifier": {0: "云", 1: "阴影", 2: "拉花", 3: "模糊", 4: "光谱溢出", 5: "扭曲", 6: "拼接痕迹", 7: "拼接错误", 8: "条状噪声"},
    "segmenter": {0: "背景", 1: "云", 2: "阴影", 3: "拉花", 4: "模糊", 5: "光谱溢出", 6: "扭曲"},
}

# fixed values: which kind of answer a label gets
FAMILIES: dict[str, list[str]] = {"area": ["云", "阴影", "拉花", "扭曲", "模糊", "光谱溢出"], "seam": ["拼接痕迹", "拼接错误", "色差"], "pixel": ["条状噪声", "像素缺失"]}

# fixed values: names of the nine cells, row by row, and of no cell
CELLS = ["左上角", "上方", "右上角", "左边", "中间", "右边", "左下角", "下方", "右下角"]
NO_CELL = "无"

# fixed values: names of the six regions and of the line in each
REGIONS = ["左边", "右边", "中间", "上边", "下边", "中间"]
LINES = ["竖线", "竖线", "竖线", "横线", "横线", "横线"]

# fixed values: caption parts by language
CAPTION = {
    "zh": {"large": "大面积的", "small": "小面积的", "none": "卫星图像完全合格。", "start": "卫星图像有", "join": "，", "end": "。"},
    "en": {"large": "large area of ", "small": "small area of ", "none": "The satellite image has only background.", "start": "A satellite image has ", "join": " and ", "end": ""},
}
QUALIFIED = "合格"

# fixed values: question and answer parts
QA = {
    "overall": "这张卫星图像是否有质量问题？",
    "overall_no": "否，这张卫星图像没有质量问题。",
    "overall_yes": "是，这张卫星图像有质量问题，问题类型有：",
    "list": "、",
    "stop": "。",
    "ask": "这张卫星图像中是否存在",
    "ask_end": "？",
    "absent": "否，这张卫星图像中不存在",
    "all": "是，这张卫星图像几乎全是",
    "there": "是，这张卫星图像中存在",
    "maybe": "是，这张卫星图像中可能存在",
    "many": "多处",
    "one": "一处",
    "mostly": "，主要位于图像的",
    "seam": "一条",
    "seam_trace": "的痕迹，位于图像的",
    "seam_is": "，大致是",
    "seam_end": "的。",
    "across": "横向",
    "upright": "纵向",
    "places": "处",
}
#: fixed values: area above the threshold -> word, largest first
AREA_WORDS = [(0.4, "大面积的"), (0.1, "中等面积的"), (0.01, "小面积的"), (0.0, "微小的")]
TITLE = ("这张卫星影像存在", "，分界线在", "，是一条", "。")

# fixed values: the marks that text augmentation inserts, and the caption of an empty error list
MARKS = [".", ",", "!", "?", ";", ":"]
NO_ERROR = "no error"
ERROR_QUESTION = "Is there any error? "


def family(name: str) -> str | None:
    return next((f for f, names in FAMILIES.items() if name in names), None)


def label_dim(spark: SparkSession, vocab: str | None = None) -> DataFrame:
    """label_dim(vocab, label_id, label_name, family): a few dozen rows at most."""
    rows = [(v, i, n, family(n)) for v, ids in VOCABULARIES.items() for i, n in ids.items() if vocab in (None, v)]
    return spark.createDataFrame(rows, "vocab string, label_id int, label_name string, family string")
