"""Several values packed in one field: one row per value, with its place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import PackedTokenizer

#: Whatever separates is none of these, so a text of these alone holds one value at most.
_NEVER_SEPARATES = r"""^[\p{L}\p{N} ._'"()\[\]-]*$"""


def known_terms(terms: DataFrame, most: int = 200_000) -> dict[str, list[str]]:
    """Known values by field, to send to every task, so their number is checked: more than ``most`` are refused here, see ``split_packed_by_terms``."""
    rows = _given(terms).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} known terms: too many to send to every task")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.field_name, []).append(r.term)
    return by


def _given(terms: DataFrame) -> DataFrame:
    return terms.select("field_name", "term").filter("field_name is not null and term is not null")


def split_packed(
    df: DataFrame,
    key: str,
    fields: list[str],
    terms: dict[str, list[str]] | None = None,
    least: int = 2,
    brackets: bool = False,
) -> DataFrame:
    """One row (key, field_name, item_no, item) per value of each of ``fields`` that holds at least ``least`` values.

    The quote-aware scanner of ``functions.packed`` runs over Arrow batches without a shuffle; equal strings of a
    batch are scanned once. Null, empty and blank fields hold no value and give no row. Repeated rows
    each give theirs; repeated values each count. Extra columns are not read. ``key`` is passed through, null too.
    """
    key_type = df.schema[key].dataType.simpleString()
    by_field = {f: (terms or {}).get(f, []) for f in fields}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = {f: PackedTokenizer(t, brackets=brackets) for f, t in by_field.items()}
        for batch in batches:
            keys = batch.column(0)
            for at, field in enumerate(fields, start=1):
                coded = batch.column(at).dictionary_encode()
                values = [tokenizers[field](s) for s in coded.dictionary.to_pylist()]
                values = pa.array([v if len(v) >= least else [] for v in values], pa.list_(pa.string()))
                numbers = pa.array([range(1, len(v) + 1) for v in values.to_pylist()], pa.list_(pa.int32()))
                taken = values.take(coded.indices)
                rows = pc.list_parent_indices(taken)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(rows), pa.array([field] * len(rows)), pc.list_flatten(numbers.take(coded.indices)), pc.list_flatten(taken)],
                        names=[key, "field_name", "item_no", "item"],
                    )

    may_hold = [F.when(~F.col(f).rlike(_NEVER_SEPARATES), F.col(f)).alias(f) if least > 1 else F.col(f) for f in fields]
    narrow = df.select(key, *may_hold)
    if least > 1:
        narrow = narrow.filter(F.coalesce(*fields).isNotNull())
    return narrow.mapInArrow(scan, f"`{key}` {key_type}, field_name string, item_no int, item string")


SALTS = 16


def split_packed_by_terms(df: DataFrame, key: str, fields: list[str], terms: DataFrame, least: int = 2, brackets: bool = False, most: int = 200_000) -> DataFrame:
    """``split_packed`` with the known values of a table (field_name, term) of any size.

    Up to ``most`` known values travel to every task. Beyond that each distinct field value meets only the known values it can hold, by a join on their first
    piece, is scanned once with these, and its items are joined back to its rows; rows of one value are spread over ``SALTS`` parts of that join.
    """
    if _given(terms).limit(most + 1).count() <= most:
        return split_packed(df, key, fields, known_terms(terms, most), least, brackets)
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    rows = df.select(F.col(key).alias("__key"), long.alias("f")).select("__key", "f.*").filter(~F.col("value").rlike(_NEVER_SEPARATES) if least > 1 else F.col("value").isNotNull())
    values = rows.select("field_name", "value").distinct()
    pairs = "field_name string, value string, first string"

    def firsts(of_terms: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer = PackedTokenizer(brackets=brackets)
            for batch in batches:
                found = []
                for field, value in zip(*(c.to_pylist() for c in batch.columns)):
                    if of_terms:
                        found += [(field, value, first) for first in PackedTokenizer([value]).known]
                    else:
                        found += [(field, value, first) for first in sorted(tokenizer.firsts(value))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["field_name", "value", "first"])

        return run

    starts = values.mapInArrow(firsts(False), pairs)
    by_first = _given(terms).distinct().mapInArrow(firsts(True), pairs).withColumnRenamed("value", "term")
    held = starts.join(by_first, ["field_name", "first"]).groupBy("field_name", "value").agg(F.collect_set("term").alias("terms"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = PackedTokenizer(brackets=brackets)
        for batch in batches:
            items = [(PackedTokenizer(t, brackets=brackets) if t else plain)(v) for v, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.string()))], names=["field_name", "value", "items"])

    scanned = values.join(held, ["field_name", "value"], "left").select("field_name", "value", "terms").mapInArrow(scan, "field_name string, value string, items array<string>")
    salted = scanned.filter(F.size("items") >= least).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("__salt", F.pmod(F.hash("__key"), F.lit(SALTS)))
    out = spread.join(salted, ["field_name", "value", "__salt"]).select(F.col("__key").alias(key), "field_name", F.posexplode("items").alias("__at", "item"))
    return out.select(key, "field_name", (F.col("__at") + 1).alias("item_no"), "item")
