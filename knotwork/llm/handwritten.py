"""Files that are not the hand-written work of their repository.

A linear support-vector classifier over hashed character n-grams and path
components. Labels come from public markers in a file's leading comments (the
conventions by which tools flag their output, and banners that name a version
with a licence or an address) and from structure: how long the lines are, and
how much of the text is literals. Those comments are masked before features are
made, so that the classifier learns contents and places and finds files that
say nothing. Files without a marker are only presumed to be hand-written: those
among them that a fit on other repositories takes for the others are dropped
before the fit that decides. The validation part is split off by repository.

Features are relative frequencies of n-grams (raw and of the text's shape),
path components, and whether the same masked text stands in several
repositories; no label is derived from a feature. They are linear in the
n-grams, so scoring a file is one table look-up for each character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.parser.grammar import grammar_of, valid
from knotwork.session import cut

#: Labelled rows of each label that the classifier is fitted on, at most; taken in order of a hash of the file.
FIT_ROWS = 1000
#: Bytes of their features that come to the driver, at most; rows beyond are left out, in the same order.
FIT_BYTES = 100_000_000
#: Sizes of the hashed tables: raw n-grams, n-grams of the shape, path components.
RAW, SHAPE, PATH = 1 << 15, 1 << 15, 1 << 12
N_RAW, N_SHAPE = 4, 6
#: Copied files that are sent to all tasks, at most; more are joined by a shuffle.
BROADCAST_FILES = 200_000
#: Structure of compressed and of bulk text: characters a line, the share of characters outside literals, and characters below which neither can be told.
LONG_LINES, OUTSIDE, LEAST_BULK = 160, 0.06, 400

_HEAD = re.compile(r"\A(?:[\s\ufeff]+|//[^\n]*|/\*.*?\*/|#![^\n]*|['\"]use strict['\"];?)*", re.S)
# Public markers of written output, and what banners of libraries hold: a version with a licence or an address.
_MADE = re.compile(r"@generated\b|<auto-generated|\bauto-?generated\b|\bdo not (?:edit|modify)\b|\b(?:code|file) generated by\b|\bautomatically (?:generated|created)\b", re.I)
_VERSION = re.compile(r"(?:(?<![\w.])v?|@)\d+\.\d+\.\d+\b")
_BANNER = re.compile(r"^\s*/\*!|@license\b|@preserve\b|https?://|\blicen[cs]ed?\b", re.I | re.M)
_SUSPECT = re.compile(
    r"(?:^|/)(?:vendor|third[_-]?party|node_modules|extern|external|bower_components|generated|__generated__|gen|codegen[^/]*|openapi|dist|build|out|assets|data|public|fixtures)(?:/|$)"
    r"|[._-](?:min|bundle|pb|gen|g|generated|prod|chunk)\.|_pb\.|\.[0-9a-f]{8}\.[a-z]+$",
    re.I,
)
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|[-+0-9.,:;=\s\[\]{}]+|\b0x[0-9a-f]+|\b[a-z]\w{0,6}(?=:)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^A-Za-z0-9]+")

_CLASS = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = ord("a") if _ch.isalpha() or _c > 127 or _ch in "_$" else ord("0") if _ch.isdigit() else ord(" ") if _ch in " \t\r" else _c
#: Classes that don't melt into a run.
_STANDS = np.ones(256, dtype=bool)
_STANDS[np.frombuffer(b"a0 ", dtype=np.uint8)] = False


def masked(text: str) -> tuple[str, str]:
    """(leading comments, the rest of the text)."""
    end = _HEAD.match(text).end()
    return text[:end], text[end:]


def own_label(file: str, head: str, body: str) -> int | None:
    """1: marked, or compressed or bulk by its structure; 0: presumed hand-written; None: in an unclear place, not learned from."""
    if not body:
        return None
    if _MADE.search(head) or _VERSION.search(head) and _BANNER.search(head):
        return 1
    if len(body) >= LEAST_BULK:
        if len(body) / (body.count("\n") + 1) > LONG_LINES:
            return 1
        if body.count("(") * 200 < len(body) and len(_LITERAL.sub("", body)) < OUTSIDE * len(body):
            return 1
    return None if _SUSPECT.search(file) else 0


def _hashes(data: np.ndarray, n: int, size: int, seed: int) -> np.ndarray:
    """A table place for every n-gram of the bytes."""
    h = np.full(max(0, len(data) - n + 1), seed, dtype=np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) ^ data[i : len(data) - n + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(size - 1)).astype(np.int64)


def _shape(data: np.ndarray) -> np.ndarray:
    """Classes of characters; a run of one class of word or blank is one character."""
    s = _CLASS[data]
    if len(s) < 2:
        return s
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | _STANDS[s[1:]]
    return s[keep]


def _places(body: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(body.encode("utf-8", "replace"), dtype=np.uint8)
    return _hashes(data, N_RAW, RAW, 1), RAW + _hashes(_shape(data), N_SHAPE, SHAPE, 2)


def _path_places(file: str) -> list[int]:
    """Folders whole, the parts of the file's name, and its extensions; the repository doesn't count."""
    folders = file.split("/")[1:]
    words = ["d:" + f.lower() for f in folders[:-1]] if folders else []
    name = folders[-1] if folders else file
    words += ["n:" + w.lower() for w in _PART.findall(name)] + ["x:" + name[name.find(".") :].lower() if "." in name else "x:"]
    words += ["h:"] if re.search(r"\.[0-9a-f]{8}\.", name) else []
    return [RAW + SHAPE + int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=4).digest(), "big") % PATH for w in set(words)]


COPIED = RAW + SHAPE + PATH
WIDTH = COPIED + 1


def _row(file: str, body: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features without the copies: places and values."""
    places, values = [], []
    for p in _places(body):
        if len(p):
            u, c = np.unique(p, return_counts=True)
            places.append(u)
            values.append(c / len(p))
    own = np.array(sorted(set(_path_places(file))), dtype=np.int64)
    places.append(own)
    values.append(np.full(len(own), 0.2))
    return np.concatenate(places), np.concatenate(values).astype(np.float32)


_SKETCH = "repo string, file string, indexed_at timestamp, tie long, body_hash binary, blank boolean, label int, size long"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ties, bodies, blank, labels, sizes = [], [], [], [], []
        for file, text in zip(b.column("file").to_pylist(), b.column("source_text").to_pylist()):
            head, body = masked(text or "")
            digest = hashlib.blake2b("".join(body.split()).encode("utf-8", "replace"), digest_size=16).digest()
            ties.append(int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=7).digest(), "big"))
            bodies.append(digest)
            blank.append(not body)
            labels.append(own_label(file, head, body))
            sizes.append(8 * (min(2 * len(body), RAW + SHAPE) + 40))
        yield pa.RecordBatch.from_arrays(
            [b.column("repo"), b.column("file"), b.column("indexed_at"), pa.array(ties, pa.int64()), pa.array(bodies, pa.binary()), pa.array(blank, pa.bool_()), pa.array(labels, pa.int32()), pa.array(sizes, pa.int64())],
            ["repo", "file", "indexed_at", "tie", "body_hash", "blank", "label", "size"],
        )


class Model:
    """Weights over the raw features, a bias, and figures of the validation."""

    def __init__(self, weights: np.ndarray, bias: float, report: dict) -> None:
        self.weights, self.bias, self.report = weights.astype(np.float32), float(bias), report


def _train(rows, y: np.ndarray, strength: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of the L2-regularised squared hinge loss; rows: (places, values)."""
    w = np.zeros(WIDTH + 1)
    n = len(rows)
    alpha = np.zeros(n)
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * strength * share)
    square = np.array([float((v * v).sum()) + 1 for _, v in rows]) + diagonal
    random = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in random.permutation(n):
            p, v = rows[i]
            g = y[i] * (float(w[p] @ v) + w[WIDTH]) - 1 + alpha[i] * diagonal[i]
            new = max(alpha[i] - g / square[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[p] += step * v
                w[WIDTH] += step
                most = max(most, abs(step))
            alpha[i] = new
        if most < 1e-3:
            break
    return w[:WIDTH], w[WIDTH]


def fit(samples: list[tuple[str, str, str, int, bool]]) -> Model:
    """samples: (repo, file, masked text, label, copied)."""
    return fit_rows([(repo, *_row(file, body), label, copied) for repo, file, body, label, copied in samples])


def _place(repo: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((repo or "").encode(), digest_size=2).digest(), "big")


def fit_rows(samples: list[tuple]) -> Model:
    """samples: (repo, places, values, label, copied). A fifth of the repositories validates."""
    rows, y, held = [], [], []
    for repo, p, v, label, copied in samples:
        if copied:
            p, v = np.append(p, COPIED), np.append(v, np.float32(0.6))
        rows.append((p, v))
        y.append(1 if label else -1)
        held.append(_place(repo) % 5 == 0)
    y, held = np.array(y), np.array(held, dtype=bool)
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(WIDTH), -1.0, {"rows": len(y)})
    # each feature to unit spread; weights are given for features as they are
    square = np.zeros(WIDTH)
    for p, v in rows:
        square[p] += v.astype(np.float64) ** 2
    scale = 1 / np.sqrt(np.sqrt(square / len(rows)) + 1e-4)
    scaled = [(p, (v * scale[p])) for p, v in rows]
    norms = np.sqrt(np.mean([float(v @ v) for _, v in scaled]))
    scaled = [(p, v / norms) for p, v in scaled]
    # of the presumed ones, those that a fit on the other half of the repositories takes for the others are not learned from
    half = np.array([_place(r[0]) // 5 % 2 for r in samples], dtype=bool)
    sure = y > 0
    for side in (False, True):
        learn = np.flatnonzero(half != side)
        if (y[learn] > 0).any() and (y[learn] < 0).any():
            w, b = _train([scaled[i] for i in learn], y[learn], 1.0, 10)
            for i in np.flatnonzero((half == side) & (y < 0)):
                p, v = scaled[i]
                sure[i] = float(w[p] @ v) + b <= 0
        else:
            sure |= half == side
    best: dict = {}
    if (held & sure).any() and (~held & sure).any():
        learn, test = np.flatnonzero(~held & sure), np.flatnonzero(held & sure)
        t = y[test]
        for strength in (1.0, 10.0, 100.0):
            w, b = _train([scaled[i] for i in learn], y[learn], strength)
            own = np.array([float(w[p] @ v) + b for p, v in (scaled[i] for i in test)])
            alone = own - np.array([w[COPIED] * v[-1] if p[-1] == COPIED else 0.0 for p, v in (scaled[i] for i in test)])
            s = own
            hit, found, there = int(((s > 0) & (t > 0)).sum()), int((s > 0).sum()), int((t > 0).sum())
            f1 = 2 * hit / max(1, found + there)
            if not best or f1 > best["f1"] + 1e-9:
                best = {"f1": f1, "strength": strength, "precision": hit / max(1, found), "recall": hit / max(1, there), "held": len(test), "rows": len(y), "dropped": int((~sure).sum())}
                hit, found = int(((alone > 0) & (t > 0)).sum()), int((alone > 0).sum())
                best |= {"precision_without_copies": hit / max(1, found), "recall_without_copies": hit / max(1, there)}
    w, b = _train([r for r, x in zip(scaled, sure) if x], y[sure], best.get("strength", 10.0))
    return Model(w * scale / norms, b, best)


def _latest(parsed_files: DataFrame) -> DataFrame:
    """One row for each file, of its latest text: repo, file, indexed_at, tie, label, blank, size, copied."""
    rows = _texts(parsed_files).mapInArrow(_sketches, _SKETCH)
    newest = rows.groupBy("file").agg(F.max(F.struct("indexed_at", "tie", "repo", "body_hash", "blank", "label", "size")).alias("r")).select("file", "r.*")
    # the same text in two repositories is not the work of one of them
    spread = (
        newest.where(~F.col("blank"))
        .groupBy("body_hash")
        .agg(F.min("repo").alias("a"), F.max("repo").alias("b"))
        .where(F.col("a") < F.col("b"))
        .select("body_hash", F.lit(True).alias("copied"))
    )
    return newest.join(spread, "body_hash", "left").withColumn("copied", F.coalesce("copied", F.lit(False))).drop("body_hash")


def _texts(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.where(F.col("file").isNotNull()).select("repo", "file", F.col("indexed_at").cast("timestamp").alias("indexed_at"), "source_text")


def _tie(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=7).digest(), "big")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files, ties, places, values = [], [], [], []
        for file, text in zip(b.column("file").to_pylist(), b.column("source_text").to_pylist()):
            p, v = _row(file, masked(text or "")[1])
            files.append(file)
            ties.append(_tie(text))
            places.append(p.astype(np.int32).tobytes())
            values.append(v.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), b.column("indexed_at"), pa.array(ties, pa.int64()), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            ["file", "indexed_at", "tie", "places", "values"],
        )


def fit_on(parsed_files: DataFrame, latest: DataFrame) -> Model:
    """Fits on at most FIT_ROWS files of each label and FIT_BYTES of features, the first by a hash of their names.

    A copy in another repository speaks against a presumed label, so such files
    are not learned from unless they are marked.
    """
    named = latest.where(~F.col("blank") & ((F.col("label") == 1) | ((F.col("label") == 0) & ~F.col("copied"))))
    chosen, left = [], [FIT_BYTES // 2, FIT_BYTES // 2]
    for label in (0, 1):
        for r in named.where(F.col("label") == label).orderBy(F.xxhash64("file"), "file").select("repo", "file", "tie", "copied", "label", "size").limit(FIT_ROWS).collect():
            if r["size"] <= left[label]:
                left[label] -= r["size"]
                chosen.append((r["repo"], r["file"], r["tie"], r["copied"], r["label"]))
    keys = F.broadcast(parsed_files.sparkSession.createDataFrame(chosen, "repo string, file string, tie long, copied boolean, label int"))  # at most 2 * FIT_ROWS rows without texts
    sampled = (
        _texts(parsed_files)
        .join(keys.select("file"), "file", "left_semi")
        .mapInArrow(_features, "file string, indexed_at timestamp, tie long, places binary, values binary")
        .join(keys, ["file", "tie"])
        .dropDuplicates(["file"])
        .select("repo", "file", "places", "values", "label", "copied")
    )
    rows = sampled.collect()
    return fit_rows(
        [(r["repo"], np.frombuffer(r["places"], dtype=np.int32).astype(np.int64), np.frombuffer(r["values"], dtype=np.float32), r["label"], r["copied"]) for r in sorted(rows, key=lambda r: r["file"])]
    )


def _scorer(weights: np.ndarray, bias: float):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, ties, out = [], [], []
            for n, (file, text, copied) in enumerate(zip(b.column("file").to_pylist(), b.column("source_text").to_pylist(), b.column("copied_tie").to_pylist())):
                body = masked(text or "")[1]
                if not body:
                    continue
                s = bias + 0.2 * float(weights[_path_places(file)].sum())
                for p in _places(body):
                    if len(p):
                        s += float(weights[p].sum()) / len(p)
                tie = None
                if copied is not None:
                    tie = _tie(text)
                    s += 0.6 * float(weights[COPIED]) if tie == copied else 0.0
                if s <= 0:
                    continue
                own = grammar_of(file)
                if own is not None and not valid(text, own):
                    continue
                kept.append(n)
                ties.append(_tie(text) if tie is None else tie)
                out.append(s)
            some = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("file"), some.column("indexed_at"), pa.array(ties, pa.int64()), pa.array(out, pa.float64())], ["file", "indexed_at", "tie", "score"])

    return scores


def not_handwritten(parsed_files: DataFrame) -> DataFrame:
    """file, score of every file that is not hand-written, from its row with the latest indexed_at.

    Files whose text is empty, null, nothing but comments, or not valid for its
    extension are no cases; neither are rows without a file. A null indexed_at
    is the earliest; of rows equally late the one with the greater checksum
    counts. Without labelled files of both kinds nothing can be learned, and no
    file is a case.
    """
    latest = cut(_latest(parsed_files))
    model = fit_on(parsed_files, latest)
    copies = latest.where("copied").select("file", F.col("tie").alias("copied_tie"))
    if copies.count() <= BROADCAST_FILES:
        copies = F.broadcast(copies)
    scored = (
        _texts(parsed_files)
        .join(copies, "file", "left")
        .mapInArrow(_scorer(model.weights, model.bias), "file string, indexed_at timestamp, tie long, score double")
    )
    newest = latest.select("file", F.col("tie").alias("t"), F.col("indexed_at").alias("at"))
    return (
        scored.join(newest, "file")
        .where((F.col("tie") == F.col("t")) & F.col("indexed_at").eqNullSafe(F.col("at")))
        .groupBy("file")
        .agg(F.max("score").alias("score"))
    )
