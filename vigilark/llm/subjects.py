"""Subject areas of documents by a chain of calibrated classifiers.

Features are terms (words of any script, pairs of neighbouring words, runs of katakana and kanji, character pairs of scripts
without spaces) counted over the whole text, the same terms by the part of the document they stand in (before the description, claims), and the source. From labelled documents every term
gets its affinity to each subject; a document's terms then add up to a few measures per subject: how much of it speaks of the
subject, by how many different terms, in which parts. One logistic model per subject sees these measures and the
subjects before it in the chain, so that subjects which occur together, or exclude each other, do so in the prediction; a
passing mention has few different terms and none in the claims. Scores are calibrated on labelled documents kept out of the
fit; a beam search over the chain picks the most probable combination of one or two subjects.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Labelled documents the classifiers are fitted on, at most; taken in the order of a hash of the id.
MAX_LABELLED = 12_000
#: Hash space of one block of features, and the blocks: words, pairs, words before the description, words in the claims, source.
SPACE = 1 << 17
BLOCKS = 5
DIM = SPACE * BLOCKS
#: Prior weight of a subject's overall share against the documents with a term.
PRIOR = 2.0
#: Folds of the affinities in training: a document's own label never tells what its terms mean.
FOLDS = 5
MEASURES = 15
#: Leans towards a second subject that are tried in the calibration.
LEANS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
WORD_CACHE = 500_000

_LATIN, _CJK = "a-zß-öø-ÿĀ-ɏḀ-ỿ", "ぁ-ヿ一-鿿々"
#: Combining marks and vowel signs that continue a word.
_MARKS = "\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0dff\u0e31-\u0e4e\u0eb1-\u0ece\u0f71-\u0fbc\u102b-\u103e\u17b4-\u17d3"
_OTHER = rf"[^\W\d_{_LATIN}{_CJK}]"
_WORDS = re.compile(rf"[{_LATIN}]{{2,}}|[ァ-ヺー]{{2,}}|[一-鿿々]+|{_OTHER}(?:{_OTHER}|[{_MARKS}])+")
_ASCII = re.compile(r"[a-z]{2,}")
#: Scripts that put no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer.
_UNSPACED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]")
_HAN, _KANA = re.compile(r"[一-鿿々]"), re.compile(r"[ぁ-ヿ]")
_LETTERS = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")
_BODY = re.compile(r"description|beschreibung|発明の詳細な説明")
_CLAIMS = re.compile(r"claims?\s*\n|(?:we|i) claim|claims\s|claimed is|patentanspr|revendications|特許請求の範囲")


def _pairs(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)] or [word]


def terms(low: str) -> list[str]:
    """The words of a lower-case text in their order; character pairs where a script puts no spaces between words."""
    if low.isascii():
        found = _ASCII.findall(low)
    else:
        found = _WORDS.findall(low)
        if _UNSPACED.search(low):
            found = [p for w in found for p in (_pairs(w) if _UNSPACED.match(w) else (w,))]
        if _HAN.search(low) and not _KANA.search(low):  # Chinese; in Japanese kana stand between the words
            found = [p for w in found for p in (_pairs(w) if _HAN.match(w) else (w,))]
    return found


class Features:
    """Text and source -> sorted feature ids and weights (log of 1 + count); id // SPACE is the block."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def _hash(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        out = []
        for w in words:
            k = ids.get(w)
            if k is None:
                if len(ids) >= WORD_CACHE:
                    ids.clear()
                k = ids[w] = zlib.crc32(w.encode())
            out.append(k)
        return np.array(out, np.uint64)

    def __call__(self, text: str, source: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        low = text.lower()
        body = _BODY.search(low)
        claims = None
        for claims in _CLAIMS.finditer(low, body.end() if body else 0):  # noqa: B007
            pass
        cut = [0, body.start() if body else 0, claims.start() if claims else len(low), len(low)]
        if cut[2] < cut[1]:
            cut[2] = len(low)
        parts = [self._hash(terms(low[a:b])) for a, b in zip(cut, cut[1:])]
        h = np.concatenate(parts)
        if not len(h):  # no words, but perhaps letters
            parts = [self._hash([p for w in _LETTERS.findall(low[a:b]) for p in _pairs(w)]) for a, b in zip(cut, cut[1:])]
            h = np.concatenate(parts)
        if not len(h):
            return None
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) & np.uint64(0xFFFFFFFF)
        spread = lambda x, block: ((x * np.uint64(0x85EBCA6B) >> np.uint64(9)) & np.uint64(SPACE - 1)) + np.uint64(block * SPACE)
        feats = [spread(h, 0), spread(pairs, 1), spread(parts[0], 2), spread(parts[2], 3)]
        if source:
            feats.append(spread(np.array([zlib.crc32(source.encode())], np.uint64), 4))
        ids, n = np.unique(np.concatenate(feats), return_counts=True)
        return ids.astype(np.int32), np.log1p(n).astype(np.float32)


def featurize(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, ids ARRAY<INT>, weights ARRAY<FLOAT>) of every document with content; null and empty texts and those without a letter give no row. A text of letters
    without words (single letters, hiragana alone) has the pairs of its letters as terms."""
    return _featurize(docs, id_col, text_col, source_col, [])


def _featurize(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: Sequence[str]) -> DataFrame:
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            rows, ids, w = [], [], []
            for i, (t, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                f = make(t, s) if t else None
                if f is not None:
                    rows.append(i)
                    ids.append(f[0])
                    w.append(f[1])
            if rows:
                rest = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float32())), *rest.columns[3:]], names=["id", "ids", "weights", *keep]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *keep).where("text is not null")
    return rows.mapInArrow(run, f"id {types[id_col]}, ids array<int>, weights array<float>" + "".join(f", {k} {types[k]}" for k in keep))


def affinities(hits: np.ndarray, df: np.ndarray, base: np.ndarray) -> np.ndarray:
    """(features, subjects): how far the share of a subject among the documents with a feature exceeds half; 0 for features that
    occur in one document only or do not point to one subject. hits counts documents by feature and subject."""
    share = (hits + PRIOR * base) / (df[:, None] + PRIOR)
    a = np.maximum(0, (share - 0.4) / 0.6) * np.log1p(df)[:, None] / (1 + np.log1p(df)[:, None])
    a[df < 2] = 0
    return a.astype(np.float32)


def measures(columns: np.ndarray, a: np.ndarray, ids: np.ndarray, values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(documents, subjects, MEASURES) from the entries of n documents: per block the weight and the number of terms that speak
    for the subject, their shares among all subjects, and the subject's place."""
    at = np.searchsorted(columns, ids)
    on = at < len(columns)
    on[on] = columns[at[on]] == ids[on]
    at, values, rows, block = at[on], values[on], rows[on], ids[on] // SPACE
    k = a.shape[1]
    mass, terms = np.zeros((BLOCKS, n, k)), np.zeros((BLOCKS, n, k))
    for b in range(BLOCKS):
        sel = block == b
        r = rows[sel]
        if len(r):
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            w = a[at[sel]]
            mass[b, r[first]] = np.add.reduceat(w * values[sel][:, None], first, axis=0)
            terms[b, r[first]] = np.add.reduceat((w > 0.3).astype(np.float32), first, axis=0)
    share = lambda x: x / (x.sum(-1, keepdims=True) + 0.5)
    m, t = mass[0] + mass[1], terms[0] + terms[1]
    order = np.argsort(np.argsort(-m, axis=1, kind="stable"), axis=1, kind="stable")
    top = m.max(1, keepdims=True)
    return np.stack(
        [np.log1p(m), np.log1p(t), share(m), share(t), np.log1p(mass[2]), share(mass[2]), np.log1p(mass[3]), share(mass[3]),
         np.log1p(terms[0]), share(terms[0]), m / (top + 0.5), order == 0, order == 1, (order == 1) * (m / (top + 0.5)), mass[4]],
        axis=-1,
    )


@dataclass
class Chain:
    """The fitted chain: `columns` are the features with an affinity, `affinity` theirs by subject, `weights` of the standardised
    measures, `links` the effect of earlier subjects, `scale` and `shift` the calibration."""

    subjects: list[str]
    columns: np.ndarray
    affinity: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    #: Added to the log probability of combinations of several subjects; chosen on the labelled documents.
    lean: float = 0.0

    def raw(self, ids: np.ndarray, values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Scores from the features of n documents: ids, values and row numbers of all their entries."""
        x = measures(self.columns, self.affinity, ids, values, rows, n)
        return ((x - self.mean) / self.spread) @ self.weights + self.bias

    def decode(self, raw: np.ndarray, most: int = 2, beam: int = 16) -> np.ndarray:
        """The most probable combination of 1 to `most` subjects of each row, by beam search along the chain, several leant towards."""
        return self.choose(*self.search(raw, most, beam))

    def choose(self, state: np.ndarray, logp: np.ndarray, used: np.ndarray) -> np.ndarray:
        return state[np.arange(len(state)), np.argmax(logp + self.lean * (used > 1), 1)]

    def search(self, raw: np.ndarray, most: int = 2, beam: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combinations at the end of the beam, their log probabilities and sizes."""
        n, k = raw.shape
        state, logp, used = np.zeros((n, 1, k), bool), np.zeros((n, 1)), np.zeros((n, 1), int)
        for j in range(k):
            z = self.scale[j] * (raw[:, None, j] + state[:, :, :j] @ self.links[:j, j]) + self.shift[j]
            yes, no = logp - np.logaddexp(0, -z), logp - np.logaddexp(0, z)
            yes = np.where(used < most, yes, -np.inf)
            if j == k - 1:
                no = np.where(used > 0, no, -np.inf)
            allp = np.concatenate([no, yes], 1)
            s1 = state.copy()
            s1[:, :, j] = True
            alls, allu = np.concatenate([state, s1], 1), np.concatenate([used, used + 1], 1)
            width = min(beam, allp.shape[1])
            top = np.argpartition(-allp, width - 1, axis=1)[:, :width]
            # the empty combination stays in the beam until a subject was chosen
            empty = np.argmax(np.where(allu == 0, 1, 0), 1)
            has_empty = (allu == 0).any(1)
            missing = has_empty & ~(top == empty[:, None]).any(1)
            if j < k - 1 and missing.any():
                worst = np.argmin(np.take_along_axis(allp, top, 1), 1)
                top[missing, worst[missing]] = empty[missing]
            logp, used = np.take_along_axis(allp, top, 1), np.take_along_axis(allu, top, 1)
            state = np.take_along_axis(alls, top[:, :, None], 1)
        return state, logp, used


def _newton(x: np.ndarray, t: np.ndarray, ridge: np.ndarray, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a ridge towards `start`: Newton steps, halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - t * z).sum() + 0.5 * (ridge * (w - start) ** 2).sum())

    w, now = start.copy(), loss(start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        q = p * (1 - p)
        step = np.linalg.solve((x * q[:, None]).T @ x + np.diag(ridge), x.T @ (p - t) + ridge * (w - start))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        after = loss(w - size * step)
        if not after < now - 1e-7 * (1 + abs(now)):
            break
        w, now = w - size * step, after
    return w


def fit_chain(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, subjects: list[str], holdout: np.ndarray, group: np.ndarray) -> Chain:
    """Fits the chain on the rows outside `holdout` and calibrates it on those inside. Rows of one `group` (a number) are nearly the same
    document and stay in one fold.

    The measures of a training document use affinities from the other folds. All links are fitted together by Newton
    steps: the weights of the measures are shared, each subject has its own bias and its own links to the subjects before it; in
    training these are the true ones. Random numbers play no part.
    """
    n, k = y.shape
    flat, val = np.concatenate(ids), np.concatenate(values)
    row = np.repeat(np.arange(n), [len(x) for x in ids])
    used, at = np.unique(flat, return_inverse=True)
    f = len(used)
    fold = group % FOLDS

    def count(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on = docs[row]
        hits = np.stack([np.bincount(at[on], weights=y[row[on], j].astype(float), minlength=f) for j in range(k)], 1)
        return hits, np.bincount(at[on], minlength=f)

    hits, df = count(np.ones(n, bool))
    base = y.mean(0)
    x = np.zeros((n, k, MEASURES))
    for b in range(FOLDS):
        own = fold == b
        if not own.any():
            continue
        h, d = count(own)
        on = own[row]
        place = np.cumsum(own) - 1
        other = affinities(hits - h, df - d, base)
        on_any = other.any(1)
        x[own] = measures(used[on_any], other[on_any], flat[on], val[on], place[row[on]], int(own.sum()))
    a = affinities(hits, df, base)
    some = a.any(1)
    mean, spread = x.reshape(-1, MEASURES).mean(0), x.reshape(-1, MEASURES).std(0) + 1e-6
    z = (x - mean) / spread
    yf = y.astype(float)
    pairs = [(i, j) for j in range(k) for i in range(j)]
    fit = ~holdout
    width = MEASURES + k + len(pairs)
    rows = []
    for j in range(k):
        d = np.zeros((int(fit.sum()), width))
        d[:, :MEASURES] = z[fit, j]
        d[:, MEASURES + j] = 1
        for c, (i, jj) in enumerate(pairs):
            if jj == j:
                d[:, MEASURES + k + c] = yf[fit, i]
        rows.append(d)
    start = np.zeros(width)
    start[MEASURES : MEASURES + k] = np.log((base + 1e-3) / (1 - base + 1e-3))
    ridge = np.r_[np.full(MEASURES, 0.1), np.full(k, 5.0), np.full(len(pairs), 5.0)]
    w = _newton(np.concatenate(rows), np.concatenate([yf[fit, j] for j in range(k)]), ridge, start)
    links = np.zeros((k, k))
    for c, (i, j) in enumerate(pairs):
        links[i, j] = w[MEASURES + k + c]
    chain = Chain(subjects, used[some].astype(np.int32), a[some], mean, spread, w[:MEASURES], links, w[MEASURES : MEASURES + k], np.ones(k), np.zeros(k))
    cal = holdout if holdout.sum() >= 30 else np.ones(n, bool)
    full = (z[cal] @ chain.weights + chain.bias) + yf[cal] @ links
    for j in range(k):
        t = np.where(y[cal, j], (y[cal, j].sum() + 1) / (y[cal, j].sum() + 2), 1 / ((~y[cal, j]).sum() + 2))
        c = _newton(np.c_[full[:, j], np.ones(len(full))], t, np.array([2.0, 2.0]), np.array([1.0, 0.0]))
        chain.scale[j], chain.shift[j] = c if c[0] > 0 else (1.0, 0.0)
    # wrong and missing labels make second subjects look rarer than they are: the lean with the best share of right pairs, the least
    # such one, over all labelled rows, whose measures know nothing of their own labels
    found, best = chain.search(z @ chain.weights + chain.bias), (-1.0, 0.0)
    for lean in LEANS:
        chain.lean = lean
        got = chain.choose(*found)
        f = 2 * (got & y).sum() / max(1, got.sum() + y.sum())
        best = max(best, (round(float(f), 9), -lean))
    chain.lean = -best[1]
    return chain


def train_subjects(
    docs: DataFrame, labels: DataFrame, subjects: Sequence[str], id_col: str, text_col: str, source_col: str, label_col: str,
    max_labelled: int = MAX_LABELLED, family_col: str | None = None,
) -> Chain:
    """Chain from labelled documents: at most max_labelled of them, in the order of a hash of their id. Families (family_col; a document
    without one is a family of its own) are dealt to folds and to the calibration, a seventh of them, as a whole, so that no
    copy of a document tells what it means. Labels that are not in `subjects`, null labels and labels of unknown documents are ignored."""
    subjects = sorted(set(subjects))
    lab = labels.where(F.col(label_col).isin(list(subjects)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_set(label_col).alias("y"))
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    family = F.col(f"`{family_col}`").cast("string") if family_col else F.lit(None).cast("string")
    family = F.xxhash64(family.isNotNull(), family, F.when(family.isNull(), F.col(id_col)))
    # at most max_labelled ids
    some = docs.select(id_col, text_col, source_col, family.alias("family")).join(F.broadcast(lab.withColumnRenamed("id", id_col)), id_col)
    got = _featurize(some, id_col, text_col, source_col, ["family", "y"]).toArrow().sort_by("id")
    if not got.num_rows or not subjects:
        k = len(subjects)
        m = MEASURES
        return Chain(list(subjects), np.zeros(1, np.int32), np.zeros((1, k), np.float32), np.zeros(m), np.ones(m), np.zeros(m), np.zeros((k, k)), np.zeros(k), np.ones(k), np.zeros(k))
    lists = lambda c: [x.as_py() if x is None else np.asarray(x.values) for x in got.column(c)]
    where = {s: j for j, s in enumerate(subjects)}
    y = np.zeros((got.num_rows, len(subjects)), bool)
    for i, ys in enumerate(got.column("y").to_pylist()):
        y[i, [where[s] for s in ys]] = True
    # families by number, in the order of their hash
    group = np.unique(got.column("family").to_numpy(), return_inverse=True)[1]
    return fit_chain(lists("ids"), lists("weights"), y, list(subjects), group % 7 == 6, group // 7)


def predict_subjects(docs: DataFrame, chain: Chain, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, subject): one or two rows for every document with content. One Arrow pass, the chain (some MB) broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Features(), sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keys, ids, w = [], [], []
                for k, t, s in zip(*(part.column(i).to_pylist() for i in range(3))):
                    f = make(t, s) if t else None
                    if f is not None:
                        keys.append(k)
                        ids.append(f[0])
                        w.append(f[1])
                if not keys or not model.subjects:
                    continue
                rows = np.repeat(np.arange(len(keys)), [len(x) for x in ids])
                got = model.decode(model.raw(np.concatenate(ids), np.concatenate(w), rows, len(keys)))
                i, j = np.nonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in i], part.schema.field(0).type), pa.array([model.subjects[x] for x in j])], names=["id", "subject"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")).where("text is not null")
    return rows.mapInArrow(run, f"id {id_type}, subject string").withColumnRenamed("id", id_col)
