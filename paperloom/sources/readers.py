"""Readers by kind of file: expressions that turn content into text, and the protocols of models and dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profiles


def _lines(texts: Column) -> Column:
    return F.array_join(texts, "\n")


#: A reader by kind, or by category where no kind fits: a column of text from the column of content.
READERS: dict[str, Callable[[Column], Column]] = {
    "txt": lambda c: c,
    "md": lambda c: c,
    "csv": lambda c: c,
    "json": lambda c: _lines(profiles.json_fragments(c)),
    "xml": lambda c: _lines(profiles.xml_texts(c)),
    "html": lambda c: profiles.visible_text(c),
}
BY_CATEGORY = {"document": "txt"}


def read_all(files: DataFrame, content: str, kind: str = "kind", category: str = "category") -> DataFrame:
    """Add text and reader: by the file's kind, else by its category; null and empty where no reader fits."""
    reader = F.when(F.col(kind).isin(*READERS), F.col(kind))
    for name, fallback in BY_CATEGORY.items():
        reader = F.coalesce(reader, F.when(F.col(category) == name, F.lit(fallback)))
    told = files.withColumn("reader", F.coalesce(reader, F.lit("")))
    text = F.lit(None).cast("string")
    for name, read in READERS.items():
        text = F.when(F.col("reader") == name, read(F.col(content))).otherwise(text)
    return told.withColumn("text", text)


def ask(prompts: DataFrame, generate: Callable[[str], str], prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Add a model's answer to each prompt. `generate` is the caller's; none is shipped. A prompt that fails gets null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else generate(text)
        except Exception:  # noqa: BLE001  one bad prompt must not end the job
            return None

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{answer: [one(t) for t in frame[prompt]]})

    schema = ", ".join(f"`{n}` {t}" for n, t in [*prompts.dtypes, (answer, "string")])
    return prompts.mapInPandas(answered, schema)


def type_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, aliases, markers, priority, abbreviation) of a JSON file of types; entries without a name are left out.

    Without markers the name and the aliases are the markers; priority is 50 where none is given.
    """
    schema = "canonical string, aliases array<string>, markers array<string>, priority int, abbreviation string"
    read = spark.read.schema(schema).json(path, multiLine=True).where(F.coalesce(F.trim("canonical"), F.lit("")) != "")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    markers = F.when(F.size(F.coalesce("markers", F.array().cast("array<string>"))) > 0, F.col("markers")).otherwise(F.concat(F.array("canonical"), aliases))
    return read.select(F.trim("canonical").alias("canonical"), aliases.alias("aliases"), markers.alias("markers"), F.coalesce("priority", F.lit(50)).alias("priority"), F.coalesce("abbreviation", F.lit("")).alias("abbreviation"))
