"""Text views of records: sections, documents, queries, curated sections, normalised records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def joined(separator: str, *parts: Column) -> Column:
    """The non-empty parts in order."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def section_views(df: DataFrame, id_column: str, views: Mapping[str, Sequence[str]], sections: Sequence[str]) -> DataFrame:
    """id, one text for each view (its sections by line), and has_<section> flags."""
    texts = (joined("\n", *(F.col(s) for s in parts)).alias(name) for name, parts in views.items())
    flags = (F.coalesce(F.col(s) != "", F.lit(False)).alias(f"has_{s}") for s in sections)
    return df.select(F.col(id_column), *texts, *flags)


def document_text(subject: Column, core: Column, outline: Column, remarks: Column) -> Column:
    """Subject, core items, outline item texts (structs with ``text``) and remarks, by space."""
    return joined(" ", subject, F.array_join(core, " "), F.array_join(F.transform(outline, lambda x: x["text"]), " "), remarks)


def curated_views(blob: Column, fallback_outline: Column, labels: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]], clean: Callable[[Column], Column] = lambda section: section) -> dict[str, Column]:
    """Labelled sections of one text. ``labels``: outline, objectives, schedule with their start and stop labels; an
    outline that isn't found falls back to its own field, nothing else is filled."""
    found = {n: clean(T.extract_section(blob, starts, stops)) for n, (starts, stops) in labels.items()}
    outline = T.first_nonempty(found["outline"], fallback_outline)
    return {
        "topic_text": joined("\n", outline, found["objectives"], found["schedule"]),
        "content_text": joined("\n", found["objectives"], outline, found["schedule"]),
        "parser_fallback_outline": found["outline"] == "",
    }


def normalised_records(df: DataFrame, keep: Sequence[str], rules: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Raw fields beside their normalised forms (``<field>_normalised``); nothing is replaced."""
    return df.select(*keep, *rules, *(f(F.col(c)).alias(f"{c}_normalised") for c, f in rules.items()))


def weighted_document(parts: Mapping[str, int]) -> Column:
    """Fields repeated by weight, so that a lexical model counts the seams as repeated text has them."""
    return joined(" ", *(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit(""))] * n) for c, n in parts.items()))


def encoded(df: DataFrame, id_column: str, text_column: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """id, vector from a pluggable model; ``encoder`` builds it once a task."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({id_column: part[id_column], "vector": model(part[text_column].fillna("").tolist())})

    return df.select(id_column, text_column).mapInPandas(run, f"`{id_column}` {kind}, vector array<float>")
