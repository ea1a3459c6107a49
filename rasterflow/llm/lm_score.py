"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of up to ORDER bytes over lower-cased UTF-8 texts; a text is
read after ORDER start marks and closed by an end mark (byte 255, which UTF-8 never has).
A byte is predicted in the longest context that training has seen. There, with N
occurrences of T distinct bytes, a byte seen c times has c / (N + T), and escape T / (N + T)
leads to the next shorter context, in which the bytes already passed over are excluded from N
and T. Below the empty context, all bytes not yet excluded are alike. Training counts
every context of every training text, so the bytes seen in a context are also seen in its
shorter ones, and what is excluded depends only on the context escaped from.

How it is spread out, without a table that all tasks hold:

1. Documents are dealt by a hash of their id and text to buckets of about BUCKET_BYTES. Each bucket's task
   counts its n-grams of ORDER + 1 bytes, packed in one row for each shard, and its words, in rows.
   A shard has all n-grams of a hash of the SHALLOW + 1 bytes before the last, hence all
   longer contexts of each of its n-grams; there are MAX_SHARDS at most.
2. Counts are merged shard by shard, GROUP buckets at a time, then FAN_IN merged parts at a
   time, until a shard is one row: its part of the trie, which grows with the kinds of n-grams, not with the text.
   Contexts of SHALLOW bytes or fewer are one table, of three-byte strings and their counts, which is broadcast: 2^24 rows, 200 MB, at the
   very most, and some hundred thousand in texts. Each shard's log probabilities are worked out.
3. A shard's part goes once to a task for each COPY buckets, which holds it while what the buckets ask of it streams by;
   words are summed and joined as rows.
4. Each bucket meets its answers and adds up its documents. Log probabilities travel in single precision, sums are in double.

So what is gathered grows with the corpus, a task holds a bucket or a part of
a shard, and there are more of them for more text. ``adaptive_bits`` scores one text by a model that learns as it reads.

Besides, the base: words are runs without ASCII white space, then one end token; a token
seen c times among N training tokens of V kinds has log10((c + 1) / (N + V + 1)).

Defined cases: a null or empty text is its end alone; a null id counts as an empty text
for its remainder; repeated rows count and are scored each; without training rows all
counts are 0; nothing depends on the order of documents, so there are no ties; other columns are ignored; an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize, text_bytes

ORDER = 5
BUCKET_BYTES = 16 << 20
#: Bytes of text whose n-grams are held at once.
CHUNK = 2 << 20
MARK = 255

MAX_SHARDS = 4096
#: Buckets whose rows of a shard one task takes, and merged parts that the next step takes.
GROUP, FAN_IN = 4096, 16
#: Buckets that one copy of a shard's part answers.
COPY = 1 << 18
#: Bytes of the contexts that are counted apart from the shards.
SHALLOW = 2

COUNTED = "bucket int, shard int, grams binary, n binary, word binary, c bigint"
MERGED = "shard int, part int, grams binary, n binary"
ANSWERED = "bucket int, grams binary, logs binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def grams_of(texts: list[bytes]):
    """The n-grams of all texts one after the other, and where each text's begin."""
    import numpy as np

    pad = bytes([MARK]) * ORDER
    b = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8).astype(np.uint64)
    g = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        g |= b[ORDER - k : -k] << np.uint64(8 * k)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum([0, *sizes[:-1]])
    own = np.ones(len(g), bool)
    for k in range(len(texts) - 1):  # n-grams that end in the start marks of the next text
        at = starts[k + 1] + k * ORDER
        own[at : at + ORDER] = False
    return g[own], starts


def _merged(grams, counts):
    """Distinct sorted n-grams and their summed counts."""
    import numpy as np

    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _pack(values) -> bytes:
    import zstandard

    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 1)


def _unpack(raw: bytes, kind=None):
    import numpy as np
    import zstandard

    raw = zstandard.decompress(raw)
    return raw if kind is None else np.frombuffer(raw, kind)


def _pack_sorted(values) -> bytes:
    import numpy as np

    return _pack(np.diff(values, prepend=np.uint64(0)))


def _chunks(texts):
    """(first, texts) of about CHUNK bytes, lower-cased."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append((text.as_py() or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _shard_of(grams, shards: int):
    import numpy as np

    return (((((grams >> np.uint64(8)) & np.uint64((1 << 8 * (SHALLOW + 1)) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _counter(shards: int):
    def count(table):
        import numpy as np
        import pyarrow as pa

        train, bucket = table["train"].to_numpy(zero_copy_only=False), table["bucket"][0].as_py()
        words, grams, counts = Counter(), [], []
        for first, texts in _chunks(table["text"]):
            flags = train[first : first + len(texts)]
            for learn in (True, False):
                some = [t for t, f in zip(texts, flags) if f == learn]
                if some:
                    g, n = np.unique(grams_of(some)[0], return_counts=True)
                    grams.append(g)
                    counts.append(n if learn else np.zeros(len(n), np.int64))
                for t in some:
                    if learn:
                        words.update(t.split())
                    else:
                        words.update(dict.fromkeys(t.split(), 0))
        g, n = _merged(np.concatenate(grams), np.concatenate(counts))
        shard = _shard_of(g, shards)
        order = np.argsort(shard, kind="stable")
        g, n, shard = g[order], n[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        parts = list(zip(first.tolist(), [*first[1:].tolist(), len(g)]))
        rows, kinds = len(parts), len(words)
        column = lambda values, empty, kind: pa.array([*values, *[None] * empty], kind)
        return pa.table({
            "bucket": pa.array([bucket] * (rows + kinds), pa.int32()),
            "shard": column(shard[first].tolist(), kinds, pa.int32()),
            "grams": column([_pack_sorted(g[a:b]) for a, b in parts], kinds, pa.binary()),
            "n": column([_pack(n[a:b]) for a, b in parts], kinds, pa.binary()),
            "word": pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array(list(words), pa.binary())]),
            "c": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(list(words.values()), pa.int64())]),
        })

    return count


def _merge(table):
    """One row of a shard's rows."""
    import numpy as np
    import pyarrow as pa

    g, n = _merged(np.concatenate([_grams(x) for x in table["grams"]]), np.concatenate([_unpack(x.as_py(), np.int64) for x in table["n"]]))
    return pa.table({"shard": table["shard"][:1], "part": table["part"][:1], "grams": pa.array([_pack_sorted(g)], pa.binary()), "n": pa.array([_pack(n)], pa.binary())})


def _grams(packed):
    import numpy as np

    return np.cumsum(_unpack(packed.as_py(), np.uint64), dtype=np.uint64)


def _shallow(batches):
    """The training counts of the last SHALLOW + 1 bytes, from packed rows."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for grams, n in zip(batch.column(0), batch.column(1)):
            g, n = _grams(grams), _unpack(n.as_py(), np.int64)
            g, n = _merged((g & np.uint64((1 << 8 * (SHALLOW + 1)) - 1))[n > 0], n[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(n, pa.int64())], ["gram", "n"])


class Trie:
    """Counts of all contexts of the given n-grams; ``shallow`` has those of SHALLOW bytes before, (sorted strings, counts)."""

    def __init__(self, grams, counts, shallow):
        import numpy as np

        seen = counts > 0
        grams, counts = grams[seen], counts[seen]
        self.keys, self.counts, self.contexts, self.total, self.kinds = {}, {}, {}, {}, {}
        for k in range(ORDER, -1, -1):
            some, n = (grams, counts) if k > SHALLOW else shallow
            self.keys[k], self.counts[k] = _merged(some & np.uint64((1 << 8 * (k + 1)) - 1), n)
            contexts, first = np.unique(self.keys[k] >> np.uint64(8), return_index=True)
            self.contexts[k] = contexts
            self.total[k] = np.add.reduceat(self.counts[k], first) if len(first) else np.zeros(0, np.int64)
            self.kinds[k] = np.diff(np.concatenate([first, [len(self.keys[k])]]))
        self.passed = {}
        for k in range(ORDER, 0, -1):  # occurrences, in the next shorter context, of the bytes seen in this one
            if len(self.keys[k]):
                at = np.searchsorted(self.keys[k - 1], self.keys[k] & np.uint64((1 << 8 * k) - 1))
                first = np.searchsorted(self.keys[k] >> np.uint64(8), self.contexts[k])
                self.passed[k] = np.add.reduceat(self.counts[k - 1][at], first)
            else:
                self.passed[k] = np.zeros(0, np.int64)

    @staticmethod
    def _find(where, what):
        import numpy as np

        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what

    def log10(self, grams):
        """The log probability of each n-gram's last byte after the others."""
        import numpy as np

        out, open_, passed, gone = np.zeros(len(grams)), np.ones(len(grams), bool), np.zeros(len(grams)), np.zeros(len(grams))
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(ORDER, -1, -1):
                context, known = self._find(self.contexts[k], (grams >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
                key, seen = self._find(self.keys[k], grams & np.uint64((1 << 8 * (k + 1)) - 1))
                if len(self.contexts[k]):
                    left, kinds = self.total[k][context] - passed, self.kinds[k][context] - gone
                    here = open_ & known
                    hit = here & seen
                    out[hit] += np.log10(self.counts[k][key[hit]] / (left + kinds)[hit])
                    miss = here & ~seen & (kinds > 0)
                    out[miss] += np.log10((kinds / (left + kinds))[miss])
                    open_ &= ~hit
                    gone = np.where(here, self.kinds[k][context], gone)
                    if k:
                        passed = np.where(here, self.passed[k][context], passed)
        out[open_] -= np.log10(256 - gone[open_])
        return out


def _resolver(shared):
    def resolve(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                g = _grams(batch.column(1)[k])
                logs = Trie(g, _unpack(batch.column(2)[k].as_py(), np.int64), shared.value).log10(g).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([_pack(logs)], pa.binary())], ["shard", "grams", "logs"])

    return resolve


def _answer(batches):
    """The log probabilities of each bucket's n-grams in a shard: rows (kind, bucket, grams, logs), a shard's part before what is asked of it."""
    import numpy as np
    import pyarrow as pa

    every = logs = None
    for batch in batches:
        kind, found = batch.column(0).to_pylist(), []
        for k, asks in enumerate(kind):
            if asks:
                found.append(_pack(logs[np.searchsorted(every, _grams(batch.column(2)[k]))]))
            else:
                every, logs = _grams(batch.column(2)[k]), _unpack(batch.column(3)[k].as_py(), np.float32)
        some = batch.filter(pa.array([bool(x) for x in kind]))
        yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(found, pa.binary())], ["bucket", "grams", "logs"])


class _Look:
    """A hash table of n-grams in arrays; the few that share a slot are searched for."""

    def __init__(self, grams, values):
        import numpy as np

        order = np.argsort(grams)
        self.grams, self.values = grams[order], values[order]
        self.shift = np.uint64(64 - max(8, (4 * len(grams)).bit_length()))
        slot = self._slot(self.grams)
        self.key, self.value = np.zeros(1 << int(64 - self.shift), np.uint64), np.zeros(1 << int(64 - self.shift))
        self.key[slot], self.value[slot] = self.grams, self.values

    def _slot(self, grams):
        import numpy as np

        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, grams):
        import numpy as np

        slot = self._slot(grams)
        out = self.value[slot]
        other = np.flatnonzero(self.key[slot] != grams)
        out[other] = self.values[np.searchsorted(self.grams, grams[other])]
        return out


def _scorer(tokens: int, kinds: int, ends: int):
    def score(docs, answers):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        packed = answers.filter(pc.is_valid(answers["grams"]))
        grams, logs = [_grams(x) for x in packed["grams"]], [_unpack(x.as_py(), np.float32) for x in packed["logs"]]
        words = answers.filter(pc.is_valid(answers["word"]))
        known = dict(zip(words["word"].to_pylist(), np.log10(words["c"].to_numpy() + 1.0).tolist()))
        look, rest, end = _Look(np.concatenate(grams), np.concatenate(logs)), math.log10(tokens + kinds + 1), math.log10(ends + 1)
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for _, texts in _chunks(docs["text"]):
            g, starts = grams_of(texts)
            out["score"].append(np.add.reduceat(look(g), starts))
            for text in texts:
                some = text.split()
                each = np.fromiter(map(known.__getitem__, some), np.float64, len(some))
                out["n_tokens"].append(len(some) + 1)
                out["n_known"].append(int(np.count_nonzero(each)) + (ends > 0))
                out["base_score"].append(float(each.sum()) + end - (len(some) + 1) * rest)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pc.invert(docs["train"]), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([tokens] * docs.num_rows, pa.int64()), "base_score": pa.array(out["base_score"]), "score": pa.array(np.concatenate(out["score"])),
        })

    return score


def lm_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each document, as in SCORED; ``train`` is a Column that says which rows to learn from."""
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    parts = max(1, math.ceil(text_bytes(rows, "text") / bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    ends = rows.where("train").count()
    shards, groups = min(parts, MAX_SHARDS), math.ceil(parts / GROUP)
    counted = materialize(rows.groupBy("bucket").applyInArrow(_counter(shards), COUNTED), "counts")
    part = F.expr(f"bucket div {GROUP}").cast("int").alias("part")
    asked = counted.where("shard is not null").select("bucket", "shard", part, "grams", "n")
    merged = materialize(asked.groupBy("shard", "part").applyInArrow(_merge, MERGED), "merged")
    left = groups
    while left > 1:
        merged = materialize(merged.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("shard", "part").applyInArrow(_merge, MERGED), "merged")
        left = math.ceil(left / FAN_IN)
    found = merged.select("grams", "n").mapInArrow(_shallow, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    shared = spark.sparkContext.broadcast((found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()))  # bounded: see above
    no, copies = F.lit(None), math.ceil(parts / COPY)
    model = merged.select("shard", "grams", "n").mapInArrow(_resolver(shared), "shard int, grams binary, logs binary")
    model = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), no.cast("int").alias("bucket"), "grams", "logs")
    asks = asked.select("shard", F.expr(f"cast(bucket div {COPY} as int)").alias("copy"), F.lit(1).alias("kind"), "bucket", "grams", no.cast("binary").alias("logs"))
    stream = model.unionAll(asks).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    answers = stream.select("kind", "bucket", "grams", "logs").mapInArrow(_answer, ANSWERED)
    words = counted.where("word is not null").select("bucket", "word", "c")
    totals = materialize(words.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total = totals.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("kinds")).first()
    tokens, kinds = (total["tokens"] or 0) + ends, (total["kinds"] or 0) + (ends > 0)
    by_word = words.select("bucket", "word").join(totals, "word").select("bucket", no.cast("binary").alias("grams"), no.cast("binary").alias("logs"), "word", "c")
    by_gram = answers.select("bucket", "grams", "logs", no.cast("binary").alias("word"), no.cast("bigint").alias("c"))
    return rows.groupBy("bucket").cogroup(by_gram.unionAll(by_word).groupBy("bucket")).applyInArrow(_scorer(tokens, kinds, ends), SCORED)


def adaptive_bits(text: str, order: int = ORDER) -> float:
    """The code length in bits of a text and its end by a model that starts empty and learns each byte."""
    context, counts, bits = bytes([MARK]) * order, defaultdict(Counter), 0.0
    for byte in (*text.encode("utf-8", "surrogatepass").lower(), MARK):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = {b: c for b, c in counts[context[len(context) - k :]].items() if b not in excluded}
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / total)
                break
            if seen:
                bits -= math.log2(len(seen) / total)
                excluded |= seen.keys()
        else:
            bits += math.log2(256 - len(excluded))
        for k in range(order + 1):
            counts[context[len(context) - k :]][byte] += 1
        context = (context + bytes([byte]))[1:]
    return bits
