"""Text to rows: sentence packing, labelled sections, atomic topics with heading context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

SENTENCE_END = r"(?<=[。！？.!?；;])[\s\p{Z}]*"
PIECE_END = r"[；;。！？!?]"
# Heading markers and their levels, and the five contamination patterns.
NUMERAL = "[一二三四五六七八九十]+"
MARKER = rf"第{NUMERAL}[章節]|{NUMERAL}、|[0-9]+\.[0-9]+\.[0-9]+|[0-9]+\.[0-9]+|[0-9]+[\.、)]"
CONTAMINATION = {
    "assessment": "評量|考試|assessment|exam|quiz|作業|報告",
    "administrative": "office|email|電話|時間|星期|教室|授課|教師|office hour",
    "textbook": "教材|教科書|textbook|參考書|handbook",
    "schedule_note": "schedule|課程進度|note|備註|注意|copyright|智慧財產|週次|日期",
    "teaching_method": "教學方式|講授|討論|實作|teaching approach",
}


def sentence_pack(text: Column, size: int = 420, overlap: int = 60) -> Column:
    """Array of chunks: sentences are packed while they fit; a full chunk's last ``overlap`` characters open the next."""
    sentences = F.filter(F.transform(F.split(T.collapse(F.coalesce(text, F.lit(""))), SENTENCE_END), T.strip), lambda s: s != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(state, sentence):
        full = (F.length(state["now"]) > 0) & (F.length(state["now"]) + F.length(sentence) + 1 > size)
        head = F.when(full, F.substring(state["now"], -overlap, overlap)).otherwise(state["now"])
        return F.struct(
            T.strip(F.concat(head, F.lit(" "), sentence)).alias("now"),
            F.when(full, F.concat(state["out"], F.array(state["now"]))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(sentences, start, step, lambda s: F.when(F.length(s["now"]) > 0, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))


def section_chunks(df: DataFrame, id_column: str, sections: dict[str, Column], size: int = 420, overlap: int = 60) -> DataFrame:
    """id, section, section_index, chunk_id, chunk over several text fields in fixed order."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("section"), c.alias("text")) for n, c in sections.items()))).alias("s")
    packed = df.select(F.col(id_column).alias("id"), each).select("id", "s.section", F.posexplode(sentence_pack(F.col("s.text"), size, overlap)).alias("section_index", "chunk"))
    return packed.withColumn("chunk_id", F.format_string("%s-%s-%03d", F.col("id").cast("string"), "section", "section_index"))


def label_sections(df: DataFrame, id_column: str, text: Column, labels: tuple[str, ...]) -> DataFrame:
    """id, chunk_index, chunk_id, section, char_count, sha256: cut before each ``label:`` in any case; the section name
    must be lower-case letters and underscores."""
    pieces = F.filter(F.transform(F.split(T.collapse(text), rf"(?i)(?=(?:{'|'.join(labels)}):)"), T.strip), lambda p: p != "")
    rows = df.select(F.col(id_column).alias("id"), F.posexplode(pieces).alias("chunk_index", "piece"))
    section = F.coalesce(F.nullif(F.regexp_extract("piece", "^([a-z_]+):", 1), F.lit("")), F.lit("document"))
    return rows.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), F.format_string("%s:chunk:%04d", F.col("id").cast("string"), "chunk_index").alias("chunk_id"),
                       section.alias("section"), F.length("piece").cast("long").alias("char_count"), F.sha2("piece", 256).alias("sha256"))


def heading_level(marker: Column) -> Column:
    return (
        F.when(marker.rlike(rf"^第{NUMERAL}章$"), 1).when(marker.rlike(rf"^第{NUMERAL}節$"), 2).when(marker.rlike(rf"^{NUMERAL}、$"), 1)
        .when(marker.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), 3).when(marker.rlike(r"^[0-9]+\.[0-9]+$"), 2).when(marker.rlike(r"^[0-9]+[\.、)]$"), 1).otherwise(0)
    )


def contamination(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in CONTAMINATION.items())))


def lane(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, "contamination").otherwise("content")


# Fixed value: what counts as a word of a topic label.


def topic_label(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("([一-鿿A-Za-z][一-鿿A-Za-z0-9+#-]{1,30})"), F.lit(1))
    clean = F.filter(words, lambda w: F.size(contamination(w)) == 0)
    return F.when(F.size(clean) > 0, F.array_join(F.slice(clean, 1, 5), " / ")).otherwise(F.substring(text, 1, 80))


def atomic_topics(df: DataFrame, id_column: str, text: Column) -> DataFrame:
    """id, position, level, marker, chapter, topic, text: one row an atomic unit, in order, repeats dropped.

    A heading of level 1 sets the chapter and clears the topic, one of level 2 sets the topic; other units inherit.
    """
    lines = df.select(F.col(id_column).alias("id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"[\r\n]")).alias("line_no", "line")).select("id", "line_no", T.strip(F.col("line")).alias("line")).where("line != ''")
    pattern = rf"^({MARKER})[\s\p{{Z}}]*(.+)$"
    marked = lines.withColumn("marker", F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    marked = marked.withColumn("level", F.when(F.col("marker").isNull(), 0).otherwise(heading_level(F.col("marker"))))
    marked = marked.withColumn("body", F.when(F.col("marker").isNotNull(), T.topic_norm(F.regexp_extract("line", pattern, 2))))
    order = Window.partitionBy("id").orderBy("line_no")
    marked = marked.withColumn("run", F.sum((F.col("level") == 1).cast("int")).over(order))
    marked = marked.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("body")), ignorenulls=True).over(order))
    marked = marked.withColumn("topic", F.last(F.when(F.col("level") == 2, F.col("body")), ignorenulls=True).over(Window.partitionBy("id", "run").orderBy("line_no")))
    parts = F.when(F.col("marker").isNotNull(), F.array("body")).otherwise(F.split("line", PIECE_END))
    units = marked.select("id", "line_no", "level", "marker", "chapter", "topic", F.posexplode(parts).alias("piece_no", "piece"))
    value = T.topic_norm(F.regexp_replace(T.topic_norm(F.col("piece")), rf"^(?:[-*•]|[0-9]+[\.、)]|{NUMERAL}、)[\s\p{{Z}}]*", ""))
    units = units.withColumn("text", value).where(F.length("text").between(3, 300))
    first = F.row_number().over(Window.partitionBy("id", "text").orderBy("line_no", "piece_no"))
    kept = units.withColumn("n", first).where("n = 1")
    position = F.row_number().over(Window.partitionBy("id").orderBy("line_no", "piece_no")) - 1
    return kept.withColumn("position", position.cast("long")).select("id", "position", F.col("level").cast("long").alias("level"), "marker", "chapter", "topic", "text")


def atomised(df: DataFrame, id_column: str, text: Column, field: str) -> DataFrame:
    """Each record's atomic units with content addresses, lanes and a status; a record without units keeps one row."""
    units = atomic_topics(df, id_column, text).withColumnRenamed("id", id_column)
    joined = df.select(id_column).join(units, id_column, "left")
    status = F.when(F.col("text").isNull(), "present_but_no_atomic_split").otherwise("extracted")
    labels = contamination(F.coalesce("text", F.lit("")))
    return joined.select(
        id_column, F.lit(field).alias("field"), status.alias("status"), T.content_id("A-", F.col(id_column), F.lit(field), F.col("position")).alias("chunk_id"), "position", "level", "marker", "chapter",
        F.coalesce("topic", topic_label(F.col("text"))).alias("topic"), "text", F.array_join(labels, ",").alias("labels"), lane(labels).alias("lane"),
    )
