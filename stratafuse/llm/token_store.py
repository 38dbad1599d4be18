"""Operator 7: token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks. Chunks are addressed
by their digest; each is stored once, in packs of independent Zstandard frames. A document
is a recipe of chunk digests with its Merkle root; recipes are written in ascending
doc_id order, with a Merkle root for each file of them. Reading rebuilds every document from
its recipe, checks its root, and compares the files' roots with the manifest.

Writing has two passes, so that token ids never cross the network: each task tokenizes its
rows and writes the chunks new to it into a pack; small index rows then elect one copy of each
chunk, and packs are rewritten without the copies that lost. Reading goes pack by pack, with
seeks for the chunks that were elected elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C
from stratafuse.llm import files, pretokens

DIGEST = 16
#: Tokens of a chunk: bounds, and the mask whose zero bits cut (one position in 512).
LEAST, MOST, MASK, WINDOW = 128, 2048, np.uint64(511), 16
FRAME, PACK = 1 << 17, 32 << 20
#: Ids of the documents of a pack, copies included, above which the next one begins.
PACK_IDS = 128 << 20
#: One encoder a worker process and path, so that its cache serves all tasks of the process.
_encoders: dict[str, pretokens.Encoder] = {}


def encoder(path: str) -> pretokens.Encoder:
    if path not in _encoders:
        _encoders[path] = pretokens.Encoder(path)
    return _encoders[path]


_ID = C.mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def window_sums(ids: np.ndarray) -> np.ndarray:
    """Hash of each run of WINDOW ids, by runs of 1, 2, 4, ... ids."""
    x, size, base = _ID[ids & 0xFFFF], 1, 0x5851F42D4C957F2D
    with np.errstate(over="ignore"):
        while size < WINDOW:
            x, size = x[:-size] * np.uint64(base) + x[size:], 2 * size
            base = base * base % (1 << 64)
    return C.mix64(x)


def chunk_ends(ids: np.ndarray, at: np.ndarray) -> Iterator[list[int]]:
    """Ends of the content-defined chunks of each document's ids, ids[at[i]:at[i + 1]], counted from its start."""
    cuts = np.flatnonzero((window_sums(ids) & MASK) == 0) + WINDOW if len(ids) >= WINDOW else np.zeros(0, np.int64)
    between = np.searchsorted(cuts, at)
    for i, (start, stop) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        n, last, ends = stop - start, 0, []
        if n > LEAST:
            for c in (cuts[between[i] : between[i + 1]] - start).tolist():
                while c - last > MOST:
                    last += MOST
                    ends.append(last)
                if c - last >= LEAST and c < n:
                    ends.append(c)
                    last = c
            while n - last > MOST:
                last += MOST
                ends.append(last)
        yield [*ends, n]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up unchanged."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ROWS = "doc_id long, n_tokens long, recipe binary, root binary, home string, digest binary, pack string, frame_at long, frame_size long, in_frame long, size long"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _write(tokenizer: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        width = coder.kind.itemsize
        writer, name, number, seen, pending, rows, held = None, "", 0, set(), [], [], 0
        for b in batches:
            ids, at = coder.encode(b.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            data = memoryview(ids.tobytes())
            for doc, base, ends in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), chunk_ends(ids, at), strict=True):
                if writer is None:
                    name, number, seen, held = files.task_name("pack", number), number + 1, set(), 0
                    writer, pending = files.FrameWriter(f"{folder}/{name}", FRAME), []
                recipe, last = [], 0
                for stop in ends:
                    part = data[(base + last) * width : (base + stop) * width]
                    last = stop
                    d = digest(part)
                    recipe.append(d)
                    if d not in seen:
                        seen.add(d)
                        pending.append((d, len(part), *writer.add(part)))
                rows.append((doc, last, b"".join(recipe), merkle(recipe), name, None, None, None, None, None, None))
                held += last
                if writer.total >= PACK or held >= PACK_IDS:
                    yield from _closed(writer, name, pending, rows)
                    writer, rows = None, []
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if writer is not None:
            yield from _closed(writer, name, pending, rows)

    return run


def _closed(writer: files.FrameWriter, name: str, pending: list[tuple], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    writer.close()
    rows = rows + [(None, None, None, None, None, d, name, writer.frames[f][0], writer.frames[f][1], at, n) for d, n, f, at in pending]
    for i in range(0, len(rows), 20_000):
        yield _batch(rows[i : i + 20_000])


PLACES = "digest binary, pack string, frame_at long, frame_size long, in_frame long, size long, old_pack string"


def _rewrite(old: str, new: str):
    """Elected chunks of each pack, sorted by place, into a pack of the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        state: dict = {"pack": None}

        def finish() -> Iterator[pa.RecordBatch]:
            if state["pack"] is None:
                return
            w, name, done = state["writer"], state["name"], state["done"]
            w.close()
            state["file"].close()
            for i in range(0, len(done), 20_000):
                part = done[i : i + 20_000]
                cols = [[d for d, *_ in part], [name] * len(part), [w.frames[f][0] for _, f, _, _ in part], [w.frames[f][1] for _, f, _, _ in part], [at for _, _, at, _ in part], [n for *_, n in part], [state["pack"]] * len(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.string(), *[pa.int64()] * 4, pa.string()], strict=True)], [x.split()[0] for x in PLACES.split(", ")])

        for b in batches:
            for d, pack, frame_at, frame_size, at, n in zip(*(b.column(c).to_pylist() for c in ("digest", "pack", "frame_at", "frame_size", "in_frame", "size")), strict=True):
                if pack != state["pack"]:
                    yield from finish()
                    fs, path = files.open_fs(f"{old}/{pack}")
                    name = pack + f"-{TaskContext.get().taskAttemptId()}"
                    state = {"pack": pack, "name": name, "writer": files.FrameWriter(f"{new}/{name}", FRAME), "done": [], "file": fs.open_input_file(path), "frame": None}
                if frame_at != state["frame"]:
                    state["file"].seek(frame_at)
                    state["frame"], state["raw"] = frame_at, unpack.decompress(state["file"].read(frame_size))
                state["done"].append((d, *state["writer"].add(state["raw"][at : at + n]), n))
        yield from finish()

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes with the ids before each within its file."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = np.asarray(b.column("n_tokens"))
        before = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64())], [*b.schema.names, "part", "before"])


FILES = "part long, documents long, tokens long, whole boolean, root binary"


def _file_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file of recipes, from its documents in order: documents, tokens, whether each one's
    ``before`` is the tokens before it, and the Merkle root over their ids and roots."""
    now, leaves, at, whole = None, [], 0, True

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.int64()), (len(leaves), pa.int64()), (at, pa.int64()), (whole, pa.bool_()), (merkle(leaves), pa.binary()))], ["part", "documents", "tokens", "whole", "root"])

    for b in batches:
        for p, doc, before, n, r in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "before", "n_tokens", "root")), strict=True):
            if p != now and now is not None:
                yield closed()
                leaves, at, whole = [], 0, True
            now, whole = p, whole and before == at
            at += n
            leaves.append(f"{doc}:".encode() + r)
    if now is not None:
        yield closed()


def _manifest(documents: DataFrame) -> DataFrame:
    rows = documents.select("part", "doc_id", "before", "n_tokens", "root")
    return rows.repartition("part").sortWithinPartitions("part", "before", "doc_id", "root").mapInArrow(_file_roots, FILES)


def write_store(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Write ``docs`` (doc_id, text, ...) below ``folder``: packs/, and the Parquet tables chunks
    (digest -> pack and place), recipes (in ascending doc_id order), manifest (Merkle roots).

    Every document ends with ``end_id``; a null or empty text is that id alone. A null doc_id
    comes first; rows of equal doc_id come in the order of their lengths and roots. Other
    columns are ignored; an empty table gives empty tables.
    """
    C.bounded_batches(spark, 500, 4)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    stage = C.work_dir(spark)
    rows = C.saved(spark, docs.mapInArrow(_write(tokenizer, end_id, f"{stage}/packs"), ROWS), stage, "rows")
    places = rows.where("digest is not null").select("digest", "pack", "frame_at", "frame_size", "in_frame", "size")
    # the elected pack is the smallest by a hash with the digest, so that no pack serves all common chunks
    elected = places.groupBy("digest").agg(F.min(F.struct(F.xxhash64("digest", "pack").alias("h"), "pack", "frame_at", "frame_size", "in_frame", "size")).alias("x")).select("digest", "x.*")
    packs = rows.where("pack is not null").select("pack").distinct().count()
    # a task a pack, whose rows here are few but whose bytes are not
    order = elected.repartition(max(1, packs), "pack").sortWithinPartitions("pack", "frame_at", "in_frame")
    order.mapInArrow(_rewrite(f"{stage}/packs", f"{folder}/packs"), PLACES).write.parquet(f"{folder}/chunks")
    chunks = spark.read.schema(PLACES).parquet(f"{folder}/chunks")
    lost = places.select("digest", F.col("pack").alias("home")).join(chunks, "digest").where("home <> old_pack")
    lost.select("home", "digest", "pack", "frame_at", "frame_size", "in_frame", "size").write.parquet(f"{folder}/elsewhere")
    recipes = rows.where("recipe is not null").select("doc_id", "n_tokens", "recipe", "root", "home")
    ordered = recipes.repartitionByRange("doc_id", "n_tokens", "root").sortWithinPartitions("doc_id", "n_tokens", "root")
    ordered = ordered.mapInArrow(_in_order, "doc_id long, n_tokens long, recipe binary, root binary, home string, part long, before long")
    ordered.write.parquet(f"{folder}/recipes")
    done = spark.read.schema(ordered.schema).parquet(f"{folder}/recipes")
    _manifest(done).write.parquet(f"{folder}/manifest")
    C.drop_work(spark, stage)


def _rebuild(folder: str, size: int):
    kind = np.dtype("<u2") if size == 2 else np.dtype("<u4")

    def run(key: tuple, docs: pa.Table, places: pa.Table) -> pa.Table:
        """One home pack: its own chunks, read through, and those elected elsewhere, by seeks."""
        unpack, chunk = zstandard.ZstdDecompressor(), {}
        p = places.sort_by([("pack", "ascending"), ("frame_at", "ascending")]).to_pydict()
        now = frame = fs_file = None
        for d, pack, at, n, off, k in zip(*(p[c] for c in ("digest", "pack", "frame_at", "frame_size", "in_frame", "size")), strict=True):
            if pack != now:
                if fs_file:
                    fs_file.close()
                fs, path = files.open_fs(f"{folder}/packs/{pack}")
                now, frame, fs_file = pack, None, fs.open_input_file(path)
            if frame != at:
                fs_file.seek(at)
                frame, raw = at, unpack.decompress(fs_file.read(n))
            chunk[d] = raw[off : off + k]
        if fs_file:
            fs_file.close()
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, part, before, recipe, root in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "part", "before", "recipe", "root")), strict=True):
            parts = [chunk[recipe[i : i + DIGEST]] for i in range(0, len(recipe), DIGEST)]
            if merkle([digest(x) for x in parts]) != root:
                raise ValueError(f"doc_id: {doc} does not match its Merkle root")
            ids = np.frombuffer(b"".join(parts), kind).astype("<u4")
            for x, v in zip(out, (doc, (part, before), len(ids), zlib.crc32(ids.tobytes()), root), strict=True):
                x.append(v)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "part": pa.array([p for p, _ in out[1]], pa.int64()), "before": pa.array([b for _, b in out[1]], pa.int64()), "n_tokens": pa.array(out[2], pa.int64()), "ids_crc32": pa.array(out[3], pa.int64()), "root": pa.array(out[4], pa.binary())})

    return run


def read_store(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a store, rebuilt from its chunks and
    checked against its Merkle root (a mismatch fails the job). start counts the ids of all
    documents before it; ids_crc32 is of the ids as little-endian unsigned 32-bit integers.

    The rebuilt documents of each file of recipes must give the manifest's count and root, so
    recipes that are lost, doubled or replaced raise ValueError before any row is returned.
    Documents of null and repeated ids are rows like all others; an empty store gives no rows.
    """
    recipes, chunks = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/chunks")
    own = chunks.select(F.col("old_pack").alias("home"), "digest", "pack", "frame_at", "frame_size", "in_frame", "size")
    places = own.unionByName(spark.read.parquet(f"{folder}/elsewhere").select(own.columns))
    docs = recipes.select("home", "doc_id", "part", "before", "recipe", "root")
    homes = max(1, docs.select("home").distinct().count())
    docs, places = docs.repartition(homes, "home"), places.repartition(homes, "home")
    built = docs.groupBy("home").cogroup(places.groupBy("home")).applyInArrow(_rebuild(folder, id_bytes), "doc_id long, part long, before long, n_tokens long, ids_crc32 long, root binary")
    root = C.work_dir(spark)
    built = C.saved(spark, built, root, "built")  # rebuilt once for the check and the result
    found = C.saved(spark, _manifest(built), root, "files")
    stored = spark.read.schema(FILES).parquet(f"{folder}/manifest")
    same = F.col("s.root").eqNullSafe(F.col("f.root")) & (F.col("s.documents") == F.col("f.documents")) & (F.col("s.tokens") == F.col("f.tokens")) & F.col("s.whole") & F.col("f.whole")
    off = stored.alias("s").join(found.alias("f"), F.col("s.part") == F.col("f.part"), "full").where(~F.coalesce(same, F.lit(False)))
    bad = off.select(F.coalesce("s.part", "f.part").alias("part")).orderBy("part").limit(5).collect()
    if bad:
        raise ValueError(f"{folder}: recipes differ from the manifest in part {', '.join(str(r['part']) for r in bad)}")
    from pyspark.sql import Window

    # one row a file of recipes
    bases = found.select("part", F.col("tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return built.join(F.broadcast(bases.select("part", "base")), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.work_dir(spark) + "/store"
    write_store(spark, C.documents(spark, sf_dir), folder, tokenizer_path())
    return read_store(spark, folder)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token ids, written to the store and read back: a row for each row. Null and empty
    texts are the end id alone; null doc_ids come first, repeated rows (which mixing makes) stand side by side;
    other columns are ignored, and an empty table gives no rows."""
    folder = C.work_dir(spark) + "/store"
    write_store(spark, docs, folder, tokenizer_path())
    return read_store(spark, folder)
