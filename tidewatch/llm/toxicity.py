"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so token labels come first: in documents marked toxic, a token is labelled
toxic if it or its stem hardly ever stands in documents that aren't. A two-state chain over word, prefix
and suffix features is fitted to those labels by its likelihood. Forward-backward then gives each token of a
document the probability that it is toxic; a document's score is a logistic function of those marginals, and
stretches of tokens at one half or more are its offending offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = re.compile(r"[^\W\d_]+")
#: Hash space of the token features, and tokens whose emission a worker remembers.
SPACE, MEMO_ENTRIES = 1 << 18, 400_000


def token_features(token: str) -> list[int]:
    """Hashed features of a blank-separated token: a constant one, its letters in lower case as a whole, three prefixes and a suffix."""
    word = "".join(WORD.findall(token)).lower()
    if not word:
        return [0]
    return [0] + [1 + zlib.crc32(x.encode()) % (SPACE - 2) for x in (f"w {word}", f"4 {word[:4]}", f"5 {word[:5]}", f"6 {word[:6]}", f"s {word[-4:]}")]


@dataclass
class Chain:
    """Feature weights and ``move[previous][next]`` log-weights of the two states, and the document model over marginals."""

    weights: object
    move: tuple[tuple[float, float], tuple[float, float]]
    document: tuple[float, ...]


def marginals(emissions, starts, lengths, move):
    """P(state 1) of each token of the chains that lie one after another in ``emissions`` (log-odds), by forward-backward.

    Both passes run over all chains at once, longest first, a position at a time, in log-odds.
    """
    import numpy as np

    (m00, m01), (m10, m11) = move
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n = len(emissions)
    forward, backward = np.zeros(n), np.zeros(n)
    if not n:
        return forward
    ends = starts + lengths - 1
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    live = int(active[0])
    r = emissions[starts[:live]]
    forward[starts[:live]] = r
    b = np.zeros(live)
    for t in range(1, longest):
        live = int(active[t])
        r = r[:live]
        at = starts[:live] + t
        r = emissions[at] + np.logaddexp(m01, m11 + r) - np.logaddexp(m00, m10 + r)
        forward[at] = r
    b = np.zeros(int(active[0]))
    for t in range(1, longest):
        live = int(active[t])
        b = b[:live]
        at = ends[:live] - t
        x = emissions[at + 1] + b
        b = np.logaddexp(m10, m11 + x) - np.logaddexp(m00, m01 + x)
        backward[at] = b
    return 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))


def _document_features(p, starts, lengths):
    """For each chain: log of the expected toxic tokens, the largest marginal's log-odds, their share."""
    import numpy as np

    out = np.zeros((len(starts), 3))
    out[:, 0], out[:, 1] = np.log1p(0.0), -8.0
    full = lengths > 0
    if full.any():
        total, most = np.add.reduceat(p, starts[full]), np.maximum.reduceat(p, starts[full])
        most = np.clip(most, 1e-4, 1 - 1e-4)
        out[full, 0], out[full, 1], out[full, 2] = np.log1p(total), np.log(most / (1 - most)), np.sqrt(total / lengths[full])
    out[:, 1] /= 4
    return out


def copies(docs: list[list[str]], size: int = 16, shared: int = 5) -> list[int]:
    """A group number for each document: near copies, which share ``shared`` of the ``size`` three-word shingles of least hash, have the first one's."""
    owner: dict[int, int] = {}
    groups = []
    for i, tokens in enumerate(docs):
        shingles = {" ".join(tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2))}
        sketch = sorted(zlib.crc32(x.encode()) for x in shingles)[:size]
        seen = Counter(owner[h] for h in sketch if h in owner).most_common(1)
        group = seen[0][0] if seen and seen[0][1] >= min(shared, len(sketch)) else i
        for h in sketch:
            owner.setdefault(h, group)
        groups.append(group)
    return groups


def token_labels(docs: list[list[str]], toxic: list[int], least: int = 3, share: float = 0.03, odds: float = 20.0) -> set[int]:
    """Features (whole words and prefixes) that mark a token toxic.

    They stand in ``least`` toxic documents and in the ``share`` of them or more, and are ``odds`` times as frequent there as in
    the others. Near copies count as one document: else the rare words of a copied toxic document would pass for toxic.
    """
    seen: dict[int, tuple[int, set[int]]] = {}
    for tokens, label, group in zip(docs, toxic, copies(docs), strict=True):
        seen.setdefault(group, (label, set()))[1].update(f for t in set(tokens) for f in token_features(t)[1:5])
    marked, clean = Counter(), Counter()
    for label, found in seen.values():
        (marked if label else clean).update(found)
    n = max(1, sum(label for label, _ in seen.values()))
    m = max(1, len(seen) - n)
    return {f for f, k in marked.items() if k >= max(least, share * n) and (k / n) / ((clean[f] + 0.5) / m) >= odds}


def train(texts: list[str], toxic: list[int], weights: list[float] | None = None, segment: int = 48, rounds: int = 45, rate: float = 0.35, penalty: float = 1e-4) -> Chain:
    """The chain of labelled documents. ``weights`` tell how many documents each stands for."""
    import numpy as np

    docs = [t.split() for t in texts]
    known = token_labels(docs, toxic)
    feats = {t: token_features(t) for doc in docs for t in doc}
    # Segments hold the fit to short chains; those without a toxic token are thinned, their stand-ins weighted.
    rows, tags, scale = [], [], []
    for doc, label in zip(docs, toxic, strict=True):
        for at in range(0, len(doc), segment):
            part = doc[at : at + segment]
            tag = [int(bool(label) and any(f in known for f in feats[t][1:5])) for t in part]
            if any(tag) or zlib.crc32(" ".join(part).encode()) % 4 == 0:
                rows.append(part)
                tags.append(tag)
                scale.append(1.0 if any(tag) else 4.0)
    if not any(map(any, tags)):
        return Chain(np.full(SPACE, -2.0, np.float32), ((0.0, 0.0), (0.0, 0.0)), (-4.0, 0.0, 0.0, 0.0))
    n, width = len(rows), segment
    ids = np.full((n, width, 6), SPACE - 1, np.int64)  # the last place stands for no feature and weighs nothing
    real, y = np.zeros((n, width), bool), np.zeros((n, width))
    for i, (part, tag) in enumerate(zip(rows, tags, strict=True)):
        for j, (t, k) in enumerate(zip(part, tag, strict=True)):
            ids[i, j, : len(feats[t])] = feats[t]
            real[i, j], y[i, j] = True, k
    used, place = np.unique(ids, return_inverse=True)
    place = place.reshape(ids.shape)
    w, move = np.zeros(len(used)), np.zeros((2, 2))
    blank = np.searchsorted(used, SPACE - 1)
    scale = np.array(scale)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    total = scale.sum()
    yi = y.astype(int)
    pairs = real[:, 1:]
    for k in range(1, rounds + 1):
        e = np.where(real, w[place].sum(axis=2), 0.0)
        # Forward-backward over all segments; potentials are (0, e) and move.
        alpha, beta = np.zeros((width, n, 2)), np.zeros((width, n, 2))
        alpha[0, :, 1] = e[:, 0]
        for t in range(1, width):
            a = np.logaddexp(alpha[t - 1, :, :1] + move[0], alpha[t - 1, :, 1:] + move[1])
            a[:, 1] += e[:, t]
            alpha[t] = np.where(real[:, t, None], a, alpha[t - 1])
        for t in range(width - 2, -1, -1):
            x = beta[t + 1].copy()
            x[:, 1] += e[:, t + 1]
            b = np.stack([np.logaddexp(move[s, 0] + x[:, 0], move[s, 1] + x[:, 1]) for s in (0, 1)], axis=1)
            beta[t] = np.where(real[:, t + 1, None], b, beta[t + 1])
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - z, -60, 0)).T
        gap = np.where(real, y - p, 0.0) * scale[:, None] / total
        gw = np.bincount(place.ravel(), np.repeat(gap.ravel(), 6), len(w)) - penalty * w
        gm = np.zeros((2, 2))
        for s in (0, 1):
            for d in (0, 1):
                seen = ((yi[:, :-1] == s) & (yi[:, 1:] == d) & pairs).sum(axis=1)
                step = alpha[:-1, :, s] + move[s, d] + beta[1:, :, d] + (e.T[1:] if d else 0.0) - z
                mean = (np.exp(np.clip(step, -60, 0)).T * pairs).sum(axis=1)
                gm[s, d] = ((seen - mean) * scale).sum() / total - penalty * move[s, d]
        for x, g, m, v in ((w, gw, 0, 1), (move, gm, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[v] = 0.99 * moments[v] + 0.01 * g * g
            x += rate * (moments[m] / (1 - 0.9**k)) / (np.sqrt(moments[v] / (1 - 0.99**k)) + 1e-8)
        w[blank : blank + 1] = 0.0
    table = np.zeros(SPACE, np.float32)
    table[used] = w
    moves = tuple(tuple(float(v) for v in row) for row in move)
    chain = Chain(table, moves, (0.0, 0.0, 0.0, 0.0))
    # Document model on the sample's marginals.
    lengths = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    emissions = np.array([float(table[feats[t]].sum()) for d in docs for t in d])
    x = _document_features(marginals(emissions, starts, lengths, moves), starts, lengths)
    x = np.hstack([np.ones((len(x), 1)), x])
    target, mass = np.array(toxic, float), np.array(weights or [1.0] * len(toxic))
    mass = mass * len(mass) / mass.sum()
    v, ridge = np.zeros(4), 0.3 * np.diag([0.0, 1, 1, 1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        v = v + np.linalg.solve((x * (mass * q * (1 - q))[:, None]).T @ x + ridge + 1e-9 * np.eye(4), x.T @ (mass * (target - q)) - ridge @ v)
    chain.document = tuple(float(a) for a in v)
    return chain


def fit(docs: DataFrame, labels: DataFrame, column: str = "text", per_class: int = 700, chars: int = 12_000) -> Chain:
    """The chain of at most ``per_class`` labelled documents of each class, the least by a hash of their id, of which ``chars`` characters serve.

    Only documents that are not held out serve. The sample's ids are bounded, so they are broadcast to the documents.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = dict(known.groupBy("toxic").count().collect())
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    # Of rows that share an id, the one whose text has the least hash serves, in every run.
    text = F.left(text_of(docs, column), F.lit(chars))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_h"), text.alias("text")).join(F.broadcast(sample), "doc_id")
    texts = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("_h", "text"))["text"].alias("text")).collect()
    texts.sort(key=lambda r: r["doc_id"])
    toxic = [int(r["toxic"]) for r in texts]
    n = Counter(toxic)
    return train([r["text"] for r in texts], toxic, [counts[k] / n[k] for k in toxic])


def held_out(doc_id):
    """Rows that never serve the fit: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, chain: Chain, column: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and ``spans`` (start and end, in code points, of offending stretches) for each document.

    A null text counts as empty; an empty one has the score of a document without toxic tokens; a very long one is read whole. Labels, language, source
    and id take no part. Repeated rows are scored one by one, an empty table gives no rows, other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chain)  # SPACE weights: a fixed size

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        chain = shared.value
        table = chain.weights
        memo: dict[str, float] = {}

        def emission(token: str) -> float:
            found = memo.get(token)
            if found is None:
                found = float(table[token_features(token)].sum())
                if len(token) <= 48:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[token] = found
            return found

        for batch in batches:
            scores, spans = [], []
            for at in range(0, len(batch), 1000):
                texts = batch.slice(at, 1000).to_pylist()
                docs = [t.split() for t in texts]
                lengths = np.array([len(d) for d in docs], np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                emissions = np.fromiter((emission(t) for d in docs for t in d), float, int(lengths.sum()))
                p = marginals(emissions, starts, lengths, chain.move)
                x = _document_features(p, starts, lengths)
                odds = chain.document[0] + x @ np.array(chain.document[1:])
                scores += (1 / (1 + np.exp(-np.clip(odds, -30, 30)))).tolist()
                for text, start, n in zip(texts, starts, lengths, strict=True):
                    hits = np.flatnonzero(p[start : start + n] >= 0.5)
                    found: list[tuple[int, int, int]] = []
                    if len(hits):
                        wanted, k = set(hits.tolist()), 0
                        for k, m in enumerate(re.finditer(r"\S+", text)):
                            if k in wanted:
                                found.append((k, found[-1][1] if found and found[-1][0] == k - 1 else m.start(), m.end()))
                                if len(found) > 1 and found[-2][0] == k - 1:
                                    del found[-2]
                    spans.append([{"start": a, "end": b} for _, a, b in found])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["score", "spans"])

    found = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), scored(text_of(docs, column)).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.score").alias("score"), (F.col("found.score") >= threshold).cast("int").alias("predicted"), F.col("found.spans").alias("spans"))
