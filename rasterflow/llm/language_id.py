"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte
n-grams (pairs and triples of the lower-cased UTF-8 text) says how much the text looks
like the languages whose bit is 1 rather than those whose bit is 0: a naive Bayes
classifier, whose weight for an n-gram is the difference of its two log frequencies. A
text's margin for a bit is the mean weight of its n-grams. Decoding is loss-weighted: a language's loss
is the sum over bits of log(1 + exp(-SHARPNESS * margin)), the margin signed by the
language's bit; the smallest loss wins, and a text whose two best languages are closer than
``min_gap`` is flagged as ambiguous.

Codewords: for up to five languages all distinct splits of the languages in two; beyond, rows
drawn by a keyed hash, bits without both values dropped, the best of many draws by least distance.

Training counts n-grams of every training row on the executors; a task sends one
count for each language and n-gram it has seen. The model has LABELS * 2 * 65,536 counts at
most, whatever the input, and is the only thing that the driver gathers; more than MAX_LANGUAGES distinct labels
is an error, not a cut. Texts, never labels or ids, go into a prediction.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; of languages with
the same loss the first in the order of their names is taken, and the text is ambiguous; labels are used as they
are; without any training row every text is ``und``; repeated rows count and are
predicted each; other columns are ignored; an empty table gives an empty result. Long
texts are read in slices, never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: Features of a text: pairs first, then hashed triples.
FEATURES = 2 * BUCKETS
MAX_LANGUAGES = 256
SMOOTHING = 0.5
SHARPNESS = 8.0
MIN_GAP = 0.25
#: Rows and bytes of text taken at once.
ROWS = 500
SLICE = 1 << 20
#: A letter of any script (Unicode category L): no digit, fraction or numeral.
LETTER = r"\p{L}"

PREDICTED = "doc_id bigint, lang_pred string, score double, ambiguous boolean"


def codewords(n: int, seed: int = 0):
    """n rows of bits; any two rows differ in about half of the columns or more."""
    import numpy as np

    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [[int(0 == k or k in side) for k in range(n)] for size in range(n - 1) for side in combinations(range(1, n), size)]
        return np.array(columns, np.int8).T
    width, best = max(15, 10 * (n - 1).bit_length()), None
    for draw in range(50):
        rows = [[hashlib.blake2b(f"{seed}/{draw}/{r}/{c}".encode(), digest_size=1).digest()[0] & 1 for c in range(width)] for r in range(n)]
        code = np.array(rows, np.int8)
        code = code[:, (code.min(axis=0) != code.max(axis=0))]
        signs = 2 * code.astype(np.int32) - 1
        apart = ((code.shape[1] - signs @ signs.T) // 2)[~np.eye(n, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def _slices(texts):
    """Parts of about SLICE bytes: (bytes, owner of each run, start of each run, places whose pair is the next run's).

    Runs of a text overlap by two bytes, so that every triple is in one.
    """
    held, owners, starts, shared, size = [], [], [], [], 0
    for owner, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass").lower()
        for at in range(0, max(1, len(raw) - 2), SLICE):
            run = raw[at : at + SLICE + 2]
            if size and size + len(run) > SLICE:
                yield b"".join(held), owners, starts, shared
                held, owners, starts, shared, size = [], [], [], [], 0
            owners.append(owner)
            starts.append(size)
            if at + SLICE + 2 < len(raw):
                shared.append(size + SLICE)
            held.append(run + b"\0\0")  # no n-gram joins two texts
            size += len(run) + 2
    if held:
        yield b"".join(held), owners, starts, shared


def _features(raw: bytes, shared):
    """For each place: the pair's and the triple's feature; those with a zero byte are 0."""
    import numpy as np

    b = np.frombuffer(raw + b"\0\0", np.uint8).astype(np.uint32)
    pair = (b[:-2] << np.uint32(8)) | b[1:-1]
    triple = ((((pair << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)) + np.uint32(BUCKETS)
    pair[(b[:-2] == 0) | (b[1:-1] == 0)] = 0
    triple[(pair == 0) | (b[2:] == 0)] = 0
    pair[shared] = 0
    return pair, triple


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _count(batches):
    import numpy as np
    import pyarrow as pa

    counts: dict[str, np.ndarray] = {}
    for batch in _parts(batches):
        languages, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for language in dict.fromkeys(languages):
            total = counts.setdefault(language, np.zeros(FEATURES, np.int64))
            for raw, _, _, shared in _slices([t for k, t in zip(languages, texts) if k == language]):
                for feature in _features(raw, shared):
                    total += np.bincount(feature, minlength=FEATURES)
    for language, total in counts.items():
        total[0] = 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["lang", "feature", "n"])


class Model:
    """Languages, their codewords and the weights of each bit's classifier."""

    def __init__(self, languages: list[str], counts, seed: int = 0):
        import numpy as np

        self.languages, self.code = languages, codewords(len(languages), seed)
        ones = self.code.T.astype(np.float64) @ counts
        zeros = (1 - self.code).T.astype(np.float64) @ counts
        share = lambda c: np.log((c + SMOOTHING) / (c.sum(axis=1, keepdims=True) + SMOOTHING * c.shape[1]))
        self.weights = (share(ones) - share(zeros)).astype(np.float32)
        self.weights[:, 0] = 0

    def margins(self, texts: list[str]):
        """The mean weight of each text's n-grams, by bit."""
        import numpy as np

        sums, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for raw, owners, starts, shared in _slices(texts):
            for feature in _features(raw, shared):
                np.add.at(n, owners, np.add.reduceat((feature != 0).astype(np.int64), starts))
                for bit, weights in enumerate(self.weights):
                    np.add.at(sums[:, bit], owners, np.add.reduceat(weights[feature], starts, dtype=np.float64))
        return sums / np.maximum(n, 1)[:, None]

    def decode(self, margins, min_gap: float):
        """(language number, score, ambiguous) of each row of margins."""
        import numpy as np

        signs = 2.0 * self.code - 1
        loss = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * signs[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        gap = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        score = 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1)
        return best, score, gap < min_gap


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", seed: int = 0) -> Model | None:
    """A model of all rows that have a label and a text, or None without any."""
    import numpy as np

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    if not languages:
        return None
    table, place = counted.toArrow(), {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), FEATURES))
    for part in table.to_batches():
        names = part.column("lang").dictionary_encode()
        number = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)
        counts[number[names.indices.to_numpy()], part.column("feature").to_numpy()] = part.column("n").to_numpy()
    return Model(languages, counts, seed)


def _predictor(shared, min_gap: float, keep: list[str], text_col: str) -> Callable:
    def predict(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        model = shared.value
        for batch in _parts(batches):
            texts = batch.column(0).to_pylist()
            lettered = pc.match_substring_regex(batch.column(0), LETTER).fill_null(False).to_pylist()
            known = [k for k, found in enumerate(lettered) if found and model is not None]
            language, score, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                best, score[known], unsure[known] = model.decode(model.margins([texts[k] for k in known]), min_gap)
                for k, b in zip(known, best):
                    language[k] = model.languages[b]
            others = iter(batch.columns[1:])
            kept = [batch.column(0) if name == text_col else next(others) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(language, pa.string()), pa.array(score), pa.array(unsure)], [*keep, "lang_pred", "score", "ambiguous"])

    return predict


def identify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", min_gap: float = MIN_GAP) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred, score and ambiguous.

    The model is broadcast: MAX_LANGUAGES * 10 bits * FEATURES * 4 bytes at the very most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).alias("_text"), *[name for name in keep if name != text_col])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_predictor(shared, min_gap, keep, text_col), f"{schema}, lang_pred string, score double, ambiguous boolean")


def remainder(id_col: str = "doc_id", by: int = 3) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by
