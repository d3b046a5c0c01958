"""Operator 8, quality classifier by co-training: a classifier of the text and one of the page's metadata exchange confident
pseudo-labels over rounds; their calibrated views are combined to score all documents.

Two targets are learnt alike, `quality` and `toxic`; a document is kept when its quality score is LIMIT at least and its toxicity
score below LIMIT. The text view has shares of kinds of bytes, of each ASCII punctuation mark, statistics of words and lines, and
the presence of the words that tell the target's classes apart best in the labelled sample. The metadata view has nothing of the
text: language, source, both crossed, the stated length, and, where there is a url, its host, depth and query.

In each round each view labels for the other the EXCHANGE unlabelled documents that it is surest of, split between the classes by
their shares; one counts as sure if it is likelier of the class than a document is at large. A label from the other view weighs by how
well that view ranks the held-out documents (from TRUST_LEAST, for one no better than chance, to PSEUDO), so that a weak view adds
labels without drowning the given ones (a view better than chance by x weighs PSEUDO * x**3). `exchanged` tells how many went each way.

Fitting uses a bounded sample: of each class of each target at most LABELLED / 4 labelled documents, and POOL unlabelled ones, the
lowest by a hash of doc_id; classes weigh by their counts over all labelled documents. A fifth of the labelled ones is kept
from the rounds and tells how far a view is to be trusted; calibration and combination use scores from FOLDS folds. That bound is the only one: every document is scored on its whole text.

Defined cases: labels that are null, or of no document, are left out, and of several labels for a doc_id the largest counts; with fewer
than MIN_CLASS labelled documents in a class, over all labels, a target is not learnt (quality scores 1, toxicity 0); a null or blank
text scores quality 0 and is not kept; a null language, source or n_chars is a value of its own (n_chars: 0); a very long text is one
row of a task, with a few numbers of 8 bytes for each of its words; a null doc_id is scored but never sampled; equally sure documents are
taken in the order of their doc_ids; rows with one doc_id are scored each, and one of them is sampled; an empty table gives no rows;
extra columns, whatever their names, are kept by `kept`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, map_arrow, raw_texts, signed, table, word_hashes, worker_state, written

LABELLED, POOL, ROUNDS, EXCHANGE, PSEUDO, TRUST_LEAST, FOLDS = 6000, 4000, 3, 200, 0.3, 0.01, 5
TARGETS = ("quality", "toxic")
WORDS, MIN_CLASS, LIMIT, RIDGE = 256, 20, 0.5, 3.0
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
LANGS, SOURCES, CROSSED, HOSTS = 16, 32, 64, 32


def seen_words() -> WordHash:
    return worker_state("quality-words", WordHash)


def text_features(text: bytes, chosen: np.ndarray) -> np.ndarray:
    """Statistics of a text, then whether each of the chosen words (hashes, ascending) is in it."""
    raw = np.frombuffer(text, np.uint8)
    n = max(len(raw), 1)
    hist = np.bincount(raw, minlength=256)
    words = text.lower().split()
    h = word_hashes(words, seen_words())
    every, counts = np.unique(h, return_counts=True)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split(b"\n")
    has = np.zeros(len(chosen))
    if len(chosen) and len(every):
        at = np.minimum(np.searchsorted(every, chosen), len(every) - 1)
        has = (every[at] == chosen).astype(float)
    k = max(len(words), 1)
    upper, lower, digit, space = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[[9, 10, 11, 12, 13, 32]].sum()
    marks = hist[PUNCTUATION]
    stats = [upper / n, lower / n, digit / n, space / n, marks.sum() / n, hist[128:].sum() / n, hist[:9].sum() / n, np.log1p(k), len(every) / k, (counts.max() if len(counts) else 0) / k,
             lengths.mean() / 10 if len(words) else 0, min(lengths.max() if len(words) else 0, 1000) / 100, lengths.std() / 10 if len(words) else 0, len(set(lines)) / len(lines), k / len(lines) / 50, np.log1p(len(lines))]
    return np.concatenate([stats, np.sqrt(marks / k), has])


def bucket(value: str | None, n: int) -> int:
    return xxhash.xxh3_64_intdigest((value or "\0").encode()) % n


def meta_features(lang: str | None, source: str | None, n_chars: int | None, url: str | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + CROSSED + HOSTS + 3)
    host, _, path = (url or "").partition("://")[2].partition("/")
    at = 0
    for value, n in ((lang, LANGS), (source, SOURCES), (f"{lang}\0{source}", CROSSED), (host, HOSTS)):
        out[at + bucket(value, n)] = 1
        at += n
    out[-3:] = np.log1p(max(n_chars or 0, 0)), path.count("/"), "?" in path
    return out


def prepared(documents: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars and url of documents, null where there is no such column."""
    col = lambda c, t: F.col(c).cast(t).alias(c) if c in documents.columns else F.lit(None).cast(t).alias(c)
    return documents.select(*[col(c, t) for c, t in INPUTS.items()])


INPUTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long", "url": "string"}


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality and toxic of every document that has a label of either; written."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    return written(known.filter("quality is not null or toxic is not null").join(ids, "doc_id", "left_semi"), "labelled")


def sample(documents: DataFrame, known: DataFrame) -> DataFrame:
    """prepared(), quality and toxic of the sample; both are null in the unlabelled part; written, LABELLED + POOL rows at most."""
    by_hash = lambda df, *salt: df.orderBy(F.xxhash64(*map(F.lit, salt), "doc_id"), "doc_id")
    parts = [by_hash(known.filter(F.col(t) == c)).limit(LABELLED // 4) for t in TARGETS for c in (0, 1)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # twice as many as needed, for those that turn out to be labelled
    ids = by_hash(documents.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null"), "pool").limit(2 * POOL + LABELLED).distinct()
    pool = by_hash(ids.join(F.broadcast(ids.join(known, "doc_id", "left_semi")), "doc_id", "left_anti"), "pool").limit(POOL)
    chosen = written(chosen.distinct().unionByName(pool.select("doc_id", *[F.lit(None).cast("int").alias(t) for t in TARGETS])), "sample-ids")
    return written(prepared(documents).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "sample")


def telling_words(rows: DataFrame, target: str) -> np.ndarray:
    """Hashes of the WORDS words whose presence tells the classes of the sample's training part apart best, by chi squared."""

    def run(batch: pa.RecordBatch) -> dict:
        parts = [np.unique(word_hashes(t.lower().split(), seen_words())) if t else np.zeros(0, np.uint64) for t in raw_texts(batch)]
        return {"word": signed(np.concatenate(parts)), "y": np.repeat(np.array(batch.column("y").to_pylist(), np.int32), [len(p) for p in parts])}

    train = rows.filter(F.col(target).isNotNull() & ~held_out()).select("text", F.col(target).cast("int").alias("y"))
    total = train.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    if not total.n:
        return np.zeros(0, np.uint64)
    counts = map_arrow(train, run, "word long, y int").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).filter("n >= 10")
    n, n1 = float(total.n), float(total.n1)
    gap = F.col("n1") * n - F.col("n") * n1
    score = gap * gap / (F.col("n") * (n - F.col("n")) * max(n1 * (n - n1), 1.0) + 1.0)
    top = counts.orderBy(F.desc(score), "word").limit(WORDS)
    return np.sort(np.array([r.word for r in top.collect()], np.int64).view(np.uint64))


def held_out():
    return F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression with the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (p - y)) + penalty * b)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def logits(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(x @ b[:-1] + b[-1], -15, 15)


def share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def ranked(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """How often a document of class 1 is scored above one of class 0 (equal ones count half), by weights."""
    one, zero = y == 1, y == 0
    above = (z[one][:, None] > z[zero]) + 0.5 * (z[one][:, None] == z[zero])
    both = w[one][:, None] * w[zero]
    return float((above * both).sum() / max(both.sum(), 1e-12))


def handed_over(p: np.ndarray, free: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The documents (of free, ascending) that a view with probabilities p labels 1, and 0."""
    one = free[np.argsort(-p[free], kind="stable")[: max(1, round(EXCHANGE * rate))]]
    one = one[p[one] >= rate]
    left = np.setdiff1d(free, one)
    zero = left[np.argsort(p[left], kind="stable")[: max(1, round(EXCHANGE * (1 - rate)))]]
    return one, zero[p[zero] <= rate]


def co_trained(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, totals: tuple[int, int]) -> dict:
    """Scales, weights and calibration of both views; y: 0, 1 or nan (unlabelled); held: labelled rows that tell how well a view ranks; totals: how
    many documents have each label, which the sample's classes are weighted to."""
    known = ~np.isnan(y)
    rate = totals[1] / sum(totals)
    share_of = [max((y == c).sum(), 1) / known.sum() for c in (0, 1)]
    w = np.where(y == 1, rate / share_of[1], np.where(known, (1 - rate) / share_of[0], 0.0))
    train, cal = known & ~held, known & held
    if any((y[m] == c).sum() < 2 for m in (train, cal) for c in (0, 1)):
        train = cal = known
    scale = [(v[train].mean(0), v[train].std(0) + 1e-3) for v in views]
    views = [(v - m) / s for v, (m, s) in zip(views, scale)]
    labels = [np.where(train, y, np.nan) for _ in views]
    pseudo = [np.zeros(len(y)) for _ in views]
    weights = [fitted(v[train], y[train], w[train]) for v in views]
    exchanged = []
    for _ in range(ROUNDS):
        given = []
        for one, other in ((0, 1), (1, 0)):
            p = share(logits(views[one], weights[one]))
            trust = np.clip(PSEUDO * (2 * ranked(p[cal], y[cal], w[cal]) - 1) ** 3, TRUST_LEAST, PSEUDO)
            for c, best in zip((1, 0), handed_over(p, np.flatnonzero(~known & np.isnan(labels[other])), rate)):
                labels[other][best], pseudo[other][best] = c, trust
                given.append(len(best))
        exchanged.append(given)
        for i, v in enumerate(views):
            on = ~np.isnan(labels[i])
            weights[i] = fitted(v[on], labels[i][on], np.where(known, w, pseudo[i])[on])
    # each view is calibrated by itself, on the scores that models without a fifth of the labelled documents give that fifth; then both
    # are combined in the same way, and the views fitted once more with all of them
    labels = [np.where(known, y, x) for x in labels]
    weigh = [np.where(known, w, x) for x in pseudo]
    fold = np.where(known, np.cumsum(known) % FOLDS, -1)
    z = [np.zeros(len(y)) for _ in views]
    for i, v in enumerate(views):
        on = ~np.isnan(labels[i])
        for f in range(FOLDS):
            z[i][fold == f] = logits(v[fold == f], fitted(v[on & (fold != f)], labels[i][on & (fold != f)], weigh[i][on & (fold != f)]))
        weights[i] = fitted(v[on], labels[i][on], weigh[i][on])
    platt = [fitted(x[known][:, None], y[known], w[known], 1.0) for x in z]
    both = fitted(np.stack([logits(x[known][:, None], b) for x, b in zip(z, platt)], 1), y[known], w[known], 1.0)
    return {"scale": scale, "weights": weights, "platt": platt, "both": both, "exchanged": exchanged}


def applied(model: dict, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities by the text, by the metadata and by both."""
    z = [logits(logits((v - m) / s, b)[:, None], c) for v, (m, s), b, c in zip(views, model["scale"], model["weights"], model["platt"])]
    return share(z[0]), share(z[1]), share(logits(np.stack(z, 1), model["both"]))


def views_of(batch: pa.RecordBatch, chosen: np.ndarray) -> list[np.ndarray]:
    texts = [t or b"" for t in raw_texts(batch)]
    meta = [meta_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars", "url")))]
    return [np.array([text_features(t, chosen) for t in texts]), np.array(meta)]


def models(documents: DataFrame, labels: DataFrame) -> dict:
    """For each target the chosen words and the model (with `exchanged`: for each round the labels 1 and 0 that the text view gave and
    those that the metadata view gave), or None."""
    known = labelled(documents, labels)
    totals = known.agg(*[F.count_if(F.col(t) == c).alias(f"{t}{c}") for t in TARGETS for c in (0, 1)]).first()
    totals = {t: (totals[f"{t}0"], totals[f"{t}1"]) for t in TARGETS}
    rows = sample(documents, known)
    words = {t: telling_words(rows, t) for t in TARGETS}
    chosen = np.unique(np.concatenate(list(words.values())))

    def run(batch: pa.RecordBatch) -> dict:
        a, b = views_of(batch, chosen)
        return {"doc_id": batch.column("doc_id"), "held": batch.column("held"), "a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]} | {t: batch.column(t) for t in words}

    found = map_arrow(rows.select("*", held_out().alias("held")).withColumns({t: F.col(t).cast("double") for t in words}), run, "doc_id long, held boolean, a binary, b binary, quality double, toxic double")
    got = found.toArrow().sort_by("doc_id")  # LABELLED + POOL rows at most
    out: dict = {"words": chosen, "quality": None, "toxic": None}
    if got.num_rows:
        views = [np.frombuffer(b"".join(got[c].to_pylist()), float).reshape(got.num_rows, -1) for c in ("a", "b")]
        held = got["held"].to_numpy()
        for t in words:
            keep = np.concatenate([np.ones(views[0].shape[1] - len(chosen), bool), np.isin(chosen, words[t])])
            if min(totals[t]) >= MIN_CLASS:
                out[t] = co_trained([views[0][:, keep], views[1]], got[t].to_numpy().astype(float), held, totals[t]) | {"keep": keep}
    return out


SCORES = "p_text double, p_meta double, quality_score double, toxic_score double, keep boolean"


NAMES = ["p_text", "p_meta", "quality_score", "toxic_score", "keep"]


def judged(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns of documents under names of our own, in order, then the scores; and those names."""
    known = documents.sparkSession.sparkContext.broadcast(models(documents, labels))
    own = [f"own_{i}" for i in range(len(documents.columns))]
    more = prepared(documents).drop("doc_id").columns
    spare = documents.select(*[F.col(f"`{c}`").alias(s) for s, c in zip(own, documents.columns)], *[(F.col(c) if c in documents.columns else F.lit(None)).cast(INPUTS[c]).alias(c) for c in more])

    def run(batch: pa.RecordBatch) -> dict:
        m = known.value
        a, b = views_of(batch, m["words"])
        n = batch.num_rows
        blank = np.array([not (t or b"").split() for t in raw_texts(batch)])
        text, meta, quality = applied(m["quality"], [a[:, m["quality"]["keep"]], b]) if m["quality"] else [np.ones(n)] * 3
        toxic = applied(m["toxic"], [a[:, m["toxic"]["keep"]], b])[2] if m["toxic"] else np.zeros(n)
        quality, toxic = np.where(blank, 0.0, quality), np.where(blank, 0.0, toxic)
        return {c: batch.column(c) for c in own} | {"p_text": text, "p_meta": meta, "quality_score": quality, "toxic_score": toxic, "keep": (quality >= LIMIT) & (toxic < LIMIT)}

    return map_arrow(spare, run, ", ".join(f"`{c}` {t}" for c, t in spare.dtypes if c in own) + ", " + SCORES), own


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with p_text and p_meta (quality by each view), quality_score, toxic_score and keep, which replace columns of those names."""
    out, own = judged(documents, labels)
    return out.select(*[F.col(s).alias(c) for s, c in zip(own, documents.columns) if c not in NAMES], *NAMES)


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are kept, same columns."""
    out, own = judged(documents, labels)
    return out.filter("keep").select(*[F.col(s).alias(c) for s, c in zip(own, documents.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_text", "p_meta", "quality_score", "toxic_score")], "keep")
