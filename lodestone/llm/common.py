"""What the training-data operators share: the shared folder, batch mapping and text hashing."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters handed to a batch function at once, which bounds what a worker holds; a longer text goes alone.
CHARS_AT_ONCE = 1_000_000

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a materialised frame, or of frames made from it, that nothing reads any more."""
    names = df.inputFiles()
    for one in [x for x in _written if any(x[1] in name for name in names)]:
        _delete(*one)
        _written.remove(one)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def ship(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcasts a value of bounded size, classes of this package included, to executors that may lack the package; the function returned gives it back."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together have at most CHARS_AT_ONCE bytes, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > CHARS_AT_ONCE:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def free(name: str, columns: list[str]) -> str:
    """A column name like `name` that is not taken."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def map_texts(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list | tuple]], keep: list[str] | None = None, where: int | None = None) -> DataFrame:
    """Adds columns made from the texts, in Arrow batches, without a shuffle.

    make() runs once in each task and returns a function from a list of texts (None for null) to one list for each field.
    keep: input columns to return (all by default); one that has a field's name is replaced by it. where: position of a
    boolean field; only its true rows are returned, without that field.
    """
    names = [x.name for x in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(free("text", keep)))
    put = [x for k, x in enumerate(fields) if k != where]
    schema = T.StructType([source.schema[c] for c in keep] + put)
    arrow = to_arrow_schema(T.StructType(fields))
    n = len(keep)

    def run(batches):
        f = make()
        for whole in batches:
            for part in chunks(whole, n):
                made = [pa.array(v, arrow.field(k).type) for k, v in enumerate(f(part.column(n).to_pylist()))]
                kept = [part.column(k) for k in range(n)]
                if where is not None:
                    mask = made.pop(where)
                    kept, made = [x.filter(mask) for x in kept], [x.filter(mask) for x in made]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    return source.mapInArrow(run, schema)


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes whose powers are held at once: little enough for a core's cache.
_SEGMENT = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, _SEGMENT), _powers(_BACK, _SEGMENT)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, one text after another, and how many words each text has.

    Words are lower-cased A-Z and stand between ASCII white space; null texts have none. A word's bytes are the
    coefficients of a polynomial, taken from running sums over all texts at once.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = _LOWER[data]
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = ends[:-1][ends[:-1] < len(data)]
    first[edge] = word[edge]  # words end where a text ends
    edge = ends[1:][ends[1:] > 0] - 1
    last[edge] = word[edge]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, ends))
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        begin = start[at]
        to = max(int(np.searchsorted(stop, begin + _SEGMENT - 1, "right")), at + 1)
        size = int(stop[to - 1] - begin)  # more than a segment only for one word
        up, down = _POWERS if size < _SEGMENT else (_powers(_BASE, size + 1), _powers(_BACK, size + 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[begin : begin + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        a, b = start[at:to] - begin, stop[at:to] - begin
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out, counts


def text_key(text: Column) -> Column:
    """Tells texts of one id apart; null is a text of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("\0null")))


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def remainder(col: str, divisor: int):
    """crc32 of an id's decimal text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
