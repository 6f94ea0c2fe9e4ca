"""Quality classifier: histogram gradient-boosted trees over statistics of a document, traversed in numpy.

Trained on a bounded sample of labelled documents whose crc32(doc_id) mod 5 is not 0 (FIT_ROWS, taken in the order of a
hash of the doc_id); every document's whole text is scored. Only the text is an input of a score.

Null and empty texts have statistics of zero and get the score these lead to. Labels that are null are not learnt from; a
doc_id labelled twice is learnt from twice. Without any labelled row all scores are 0.5 (the smoothed base rate). Rows
that repeat a doc_id each get a row. Whole texts are read, however long. Of equally good splits the one on the earlier
statistic and at the lower value is taken. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.shared import per_text
from tallyloom.llm.trees import Trees, boost

#: Most labelled rows that a model is fitted on.
FIT_ROWS = 20_000
ACCEPT = 0.3
FOLDS = 5

STOP = frozenset(
    "a an and are as at be by for from he in is it of on or re that the this to was with au avec ce dans de des du elle en est et il la le les leur mais ne par pas pour que qui sur un une "
    "auf aus das dem den der die ein eine einen er für ich im ist mit nicht sich sie und von zu zum al como con del el es las los más no o para por se su sus una y".split()
)
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def statistics(text: str) -> tuple[float, ...]:
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, words, lines = len(text), text.split(), text.split("\n")
    seen = Counter(words)
    w, size = max(1, len(words)), max(1, int(raw.sum()))
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    held = [line for line in lines if line]
    top = max(seen.values(), default=0)
    pairs = len(set(zip(words, words[1:])))
    out = [
        np.log1p(n),
        np.log1p(len(words)),
        n / w,
        np.log1p(max(map(len, seen), default=0)),
        len(seen) / w,
        top / w,
        pairs / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        upper / max(1, upper + lower),
        int(raw[48:58].sum()) / size,
        int(raw[128:].sum()) / size,
        int(raw[9:14].sum() + raw[32]) / size,
        sum(c for x, c in seen.items() if x.lower() in STOP) / w,
        sum(c for x, c in seen.items() if x[0].isupper()) / w,
        sum(c for x, c in seen.items() if not x[-1].isalnum()) / w,
        np.log1p(len(lines)),
        len(set(held)) / max(1, len(held)),
        sum(line[-1] in ".!?\"'" for line in held) / max(1, len(held)),
        n / max(1, len(held)),
    ]
    return (*map(float, out), *(float(raw[ord(c)]) / w for c in MARKS))


N_STATS = len(statistics(""))


def score(model: Trees, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-model.raw(x)))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """The model from at most `rows` labelled rows; only their statistics come to the driver. Of rows that repeat a labelled
    id the text that is first in order counts, so no more than `rows` rows come however often an id stands in docs."""
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(key), key, "y").limit(rows)
    schema = pa.schema([(key, pa.int64()), ("y", pa.int32()), ("stats", pa.list_(pa.float64()))])
    work = per_text(text, [key, "y"], lambda t: (statistics(t),), schema)
    texts = docs.select(key, text)
    # the sample has at most `rows` rows of two numbers, so only the texts it names are shuffled, one a task and id
    one = texts.join(F.broadcast(chosen), key).groupBy(key, "y").agg(F.min(text).alias(text))
    found = one.mapInArrow(work, f"`{key}` long, y int, stats array<double>").toArrow()
    if not found.num_rows:
        return boost(np.zeros((0, N_STATS)), np.zeros(0))
    order = np.lexsort((found["y"].to_numpy(), found[key].to_numpy()))
    x = np.array(found["stats"].to_pylist(), float)[order]
    return boost(x, found["y"].to_numpy().astype(float)[order])


def score_documents(docs: DataFrame, model: Trees, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of docs (but those that have one of these names), then score (0 to 1) and predicted (1 if score >= ACCEPT), or other names. No shuffle."""
    docs = docs.drop(*names)
    at = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        for batch in batches:
            column = batch.column(text)
            got = np.empty(batch.num_rows)
            for lo in range(0, batch.num_rows, 256):
                x = np.array([statistics(t or "") for t in column.slice(lo, 256).to_pylist()])
                got[lo : lo + 256] = score(model, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= ACCEPT).astype(np.int32))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, at)


def crc_remainder(key: int) -> int:
    """What `held_out` tests, for one key."""
    return zlib.crc32(str(key).encode()) % FOLDS
