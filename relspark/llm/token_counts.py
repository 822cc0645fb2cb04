"""Token counts of whole texts: a map-side two-tier lookup in front of a SentencePiece model.

A BPE model can never merge across a character pair that no piece holds, so a text falls into
units whose token counts add up. The counts of the corpus's frequent units are looked up in a
compact table that is broadcast (at most ``table_size`` units, so its size does not follow the
corpus); other units are encoded by the library once and kept in a bounded cache of the worker.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relspark.llm.columns import id_and_text

SPACE = "▁"
UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*")
_WORKER: dict = {}


def splits_cleanly(model) -> bool:
    """Whether no piece of the model reaches across a unit's edge, and its normaliser keeps texts as they are."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return not any(len(p) > 1 and ("\n" in p or SPACE in p.lstrip(SPACE)) for p in pieces) and model.encode("  a  \n ﬁ ", out_type=str) == [SPACE * 2, SPACE + "a", SPACE * 2, "<0x0A>", SPACE, "ﬁ", SPACE]


def units(text: str) -> list[str]:
    """The parts of a text whose counts add up; the first has the space that the model puts before every text."""
    return UNIT.findall(" " + text.replace(SPACE, " ")) if text else []


def encoded_lengths(model, parts: list[str]) -> list[int]:
    """Tokens of each unit. A line feed closes units that start with a space, since the model adds one of its own."""
    asked = [p[1:] + "\n" if p[0] == " " else p for p in parts]
    return [len(x) - 1 for x in model.encode(asked, num_threads=1)]


def load(model_path: str):
    if model_path not in _WORKER:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        _WORKER[model_path] = (model, splits_cleanly(model))
    return _WORKER[model_path]


def frequent_units(docs: DataFrame, sample_rows: int, table_size: int) -> list[str]:
    """The most frequent units of a bounded number of rows. They decide the speed, never a count."""
    seen: Counter = Counter()
    for row in docs.select("text").take(sample_rows):
        seen.update(units(row.text))
    return [u for u, n in seen.most_common(table_size) if n > 1]


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_size: int = 1 << 15, sample_rows: int = 512, cache_size: int = 300_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null and empty texts have no bytes and no tokens; repeated rows are counted each; an empty
    table gives an empty result; other columns are not read. Texts are never cut. ``sample_rows``
    bounds the rows that the frequent table is drawn from, ``cache_size`` a worker's cache.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    model, clean = load(model_path)
    known = frequent_units(docs, sample_rows, table_size) if clean else []
    table = spark.sparkContext.broadcast(dict(zip(known, encoded_lengths(model, known), strict=True)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, clean = load(model_path)
        frequent = table.value
        cache: dict[str, int] = _WORKER.setdefault(("cache", model_path), {})
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo in range(0, len(b), 128):
                part = texts.slice(lo, 128).to_pylist()
                if clean:
                    split = [units(t) for t in part]
                    missing = set().union(*split).difference(frequent)
                    new = list(missing.difference(cache))
                    if len(cache) + len(new) > cache_size:
                        cache.clear()
                        new = list(missing)
                    cache.update(zip(new, encoded_lengths(model, new), strict=True))
                    first, second = frequent.get, cache.get
                    n = [sum([first(u) or second(u) for u in s]) for s in split]
                else:
                    n = [len(x) for x in model.encode(part, num_threads=1)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, 128), "n_bytes": pa.array([len(t.encode()) for t in part], pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
