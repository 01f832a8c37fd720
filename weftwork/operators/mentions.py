"""Which names stand in which texts: all names at once, by an automaton that reads each text once.

A trie of the names with failure links (Aho and Corasick) finds every place of every name in one pass over a text, however many
names there are. It is built once in a task. Names are counted first; more than fit one automaton are split by
how they begin into several, each of which goes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import casefold
from weftwork.operators.maxscore import sliced
from weftwork.storage import materialized, small_batches

#: Characters of the names of one automaton, about; a trie takes some fifty bytes for each.
NAME_CHARS = 4 << 20
#: What a name must not touch, before or behind it, to stand alone.
INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton_of(names: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, name in enumerate(names):
        found.add_word(name, (i, len(name)))
    found.make_automaton()
    return found


def places(automaton: ahocorasick.Automaton, text: str) -> dict[int, list[int]]:
    """Number of each name that stands alone in the text -> its first place, and how often it does."""
    out: dict[int, list[int]] = {}
    last = len(text) - 1
    for end, (i, n) in automaton.iter(text):
        start = end - n + 1
        if (start and text[start - 1] in INNER) or (end < last and text[end + 1] in INNER):
            continue
        if (seen := out.get(i)) is None:
            out[i] = [start, 1]
        else:
            seen[1] += 1
    return out


def found_in(batches: Iterator[pa.RecordBatch], automaton: ahocorasick.Automaton, known: list[str]) -> Iterator[pa.RecordBatch]:
    """id, name, start, n of the names in the texts of ``batches(id, text)``, a slice at a time: a batch of texts has very many."""
    for batch in sliced(batches):
        found = [(row, i, start, n) for row, text in enumerate(batch.column("text")) for i, (start, n) in places(automaton, text.as_py()).items()]
        rows, numbers, starts, counts = zip(*found, strict=True) if found else ((), (), (), ())
        columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array([known[i] for i in numbers], pa.string()), pa.array(starts, pa.int32()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "name", "start", "n"])


def mentions(texts: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text", name_chars: int = NAME_CHARS) -> DataFrame:
    """id, name, start, n: the first place (from 0) and the number of places of each name that stands alone in a text.

    ``names(name)`` are compared without case, as are the texts, and come back folded; repeated ones are one, null and empty ones
    name nothing. A name stands alone where no ASCII letter or digit touches it; places may overlap. Each row of
    ``texts`` is a text of its own, null has no names.
    """
    folded = materialized(names.select(casefold(F.col("name")).alias("name")).filter("name <> ''").distinct())
    chars = folded.agg(F.sum(F.length("name"))).first()[0] or 0
    parts = max(1, -(-chars // name_chars))
    small_batches(texts.sparkSession)
    given = texts.select(F.col(id_col).alias("id"), casefold(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    schema = T.StructType([given.schema["id"], T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.LongType())])
    out = None
    for part in range(parts):
        own = [r["name"] for r in folded.filter(F.pmod(F.xxhash64(F.substring("name", 1, 4)), F.lit(parts)) == part).toLocalIterator()]
        sent = given.sparkSession.sparkContext.broadcast(own)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            if not known:
                return
            yield from found_in(batches, automaton_of(known), known)

        found = given.mapInArrow(look, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)
