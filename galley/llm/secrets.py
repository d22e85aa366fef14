"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

The network (embedding, one convolution, maximum over the whole candidate, one output) is plain numpy. It is trained on
labelled findings that are made here from a seed: secrets of many forms in the places where they occur, and look-alikes
(checksums, identifiers, versions, links, long words, plain words after a credential's name). Candidates are all runs of
16 or more of the characters that secrets are made of, whichever they are, and what a credential's name is given, from 6
characters on and with any signs. Scores are calibrated by Platt's method on held-out findings, and the threshold is the
largest that keeps the wanted recall there, of all secrets and not only of those that are candidates. Candidates longer
than a chunk are read in overlapping chunks, so no part is left out.

Nulls: a null text is empty and has no findings. Rows are independent: repeated rows and null ids pass through. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import freeing, text_or_empty

#: The base patterns; a match counts from so many characters on (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "model")
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
GIVEN = re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credential)s?["']?\x20*(?:[:=]|\bis\b)\x20*["']?([^\s"'`,;<>(){}]{6,})""", re.IGNORECASE | re.ASCII)
BEFORE, AFTER, CHUNK = 24, 8, 256
SIZE, FILTERS, WIDTH = 8, 32, 5
RECALL, FINDINGS = 0.96, 9000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and non-overlapping per kind. access and hex match whole runs, so a match that is too short can't hide another."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets: long runs, and what credentials are given; of those that overlap, the longest. In order."""
    spans = [m.span() for m in RUN.finditer(text)]
    if ":" in text or "=" in text or " is " in text:
        spans += [m.span(1) for m in GIVEN.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a < out[-1][1]:
            if b - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, b)
        else:
            out.append((a, b))
    return out


def codes(text: str, start: int, end: int) -> np.ndarray:
    """Context and candidate as small numbers: printable ASCII from 3 on, 2 anything else, 1 the candidate's bounds, 0 padding."""
    parts = [text[max(0, start - BEFORE) : start], None, text[start:end], None, text[end : end + AFTER]]
    made = [np.ones(1, dtype=np.int64) if p is None else np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) for p in parts]
    return np.concatenate([x if p is None else np.where((x >= 32) & (x < 127), x - 29, 2) for p, x in zip(parts, made, strict=True)])


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {"e": r.normal(0, 0.5, (98, SIZE)), "k": r.normal(0, (2 / (WIDTH * SIZE)) ** 0.5, (WIDTH * SIZE, FILTERS)), "b": np.zeros(FILTERS), "o": r.normal(0, 0.2, FILTERS), "c": np.zeros(1)}
        self.w["e"][0] = 0
        self.platt, self.threshold = (1.0, 0.0), 0.5

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(rows, places, WIDTH * SIZE)"""
        wide = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        return self.w["e"][wide].reshape(*wide.shape[:2], WIDTH * SIZE)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self._windows(x)
        h = v @ self.w["k"]
        at = h.argmax(axis=1)
        return np.maximum(np.take_along_axis(h, at[:, None, :], axis=1)[:, 0] + self.w["b"], 0), at, v

    def logits(self, seqs: list[np.ndarray]) -> np.ndarray:
        """In chunks that overlap by WIDTH - 1, grouped by padded length; the maximum is over all chunks of a candidate."""
        features, lengths = np.zeros((len(seqs), FILTERS)), {}
        for k, s in enumerate(seqs):
            for lo in range(0, max(1, len(s) - WIDTH + 1), CHUNK):
                part = s[lo : lo + CHUNK + WIDTH - 1]
                lengths.setdefault(max(WIDTH, -(-len(part) // 32) * 32), []).append((k, part))
        for length, parts in lengths.items():
            for lo in range(0, len(parts), 512):
                x = np.zeros((len(parts[lo : lo + 512]), length), dtype=np.int64)
                for row, (_, part) in enumerate(parts[lo : lo + 512]):
                    x[row, : len(part)] = part
                np.maximum.at(features, [k for k, _ in parts[lo : lo + 512]], self.pooled(x)[0])
        return features @ self.w["o"] + self.w["c"][0]

    def score(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Calibrated probabilities."""
        if not seqs:
            return np.zeros(0)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(seqs) + b, -40, 40)))

    def train(self, seqs: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        x = np.zeros((len(seqs), max(map(len, seqs)) + WIDTH), dtype=np.int64)
        for row, s in enumerate(seqs):
            x[row, : len(s)] = s
        m, s2, t = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), 64):
                rows = order[lo : lo + 64]
                xb, t = x[rows], t + 1
                f, at, v = self.pooled(xb)
                d = (1 / (1 + np.exp(-(f @ self.w["o"] + self.w["c"][0]))) - y[rows]) / len(rows)
                g = {"o": f.T @ d, "c": np.array([d.sum()])}
                df = d[:, None] * self.w["o"] * (f > 0)
                g["b"] = df.sum(axis=0)
                best = np.take_along_axis(v, at[:, :, None], axis=1)  # (rows, FILTERS, WIDTH * SIZE)
                g["k"] = np.einsum("rfw,rf->wf", best, df)
                back = (df[:, :, None] * self.w["k"].T[None]).reshape(len(rows), FILTERS, WIDTH, SIZE)
                letters = xb[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
                g["e"] = np.zeros_like(self.w["e"])
                np.add.at(g["e"], letters, back)
                g["e"][0] = 0
                for k, w in self.w.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s2[k] = 0.999 * s2[k] + 0.001 * g[k] ** 2
                    w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s2[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, seqs: list[np.ndarray], y: np.ndarray) -> None:
        """Platt scaling by gradient steps."""
        z, a, b = self.logits(seqs), 1.0, 0.0
        spread = z.std() or 1.0
        for _ in range(500):
            d = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - y
            a, b = a - 0.5 * float((d * z).mean()) / spread**2, b - 0.5 * float(d.mean())
        self.platt = (a, b)

    def keep_recall(self, secrets: list[tuple[str, int, int]], recall: float = RECALL) -> None:
        """The largest threshold that finds this share of secrets (text, start, end) by the candidates of their texts."""
        spans = [[(a, b) for a, b in candidates(text) if a < end and start < b] for text, start, end in secrets]
        scores = self.score([codes(text, a, b) for (text, _, _), some in zip(secrets, spans, strict=True) for a, b in some]).tolist()
        best = sorted(max((scores.pop(0) for _ in some), default=0.0) for some in spans)
        self.threshold = float(best[int((1 - recall) * len(best))])


def _word(r: random.Random, lo: int = 3, hi: int = 10) -> str:
    return "".join(r.choice(["an", "er", "th", "on", "re", "ti", "st", "en", "ou", "le", "de", "ka", "mi", "so"]) for _ in range(r.randint(lo, hi) // 2 + 1))


def finding(r: random.Random) -> tuple[str, int, int, int]:
    """(text, start, end, label) of a made-up finding."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_of = lambda a, n: "".join(r.choice(a) for _ in range(n))
    hexes = random_of("0123456789abcdef", r.choice([32, 40, 64]))
    real = r.random() < 0.5
    signs = "!@#$%^&*?~+-_"
    if r.random() < 0.25:
        # what a credential's name is given: passwords of few characters and any signs, or words that only speak of them
        name = r.choice(["password", "passwd", "Password", "db_pass", "secret", "token", "pwd", "api_key", "passphrase"])
        lead = r.choice([f"{name} = ", f"{name}: ", f"{name}=", f'{name}: "', f"the {name} is "])
        chosen = [random_of(alnum, r.randint(6, 11)) + r.choice(signs) + random_of(alnum + signs, r.randint(1, 5)), _word(r, 3, 7).capitalize() + r.choice(signs) + str(r.randint(10, 9999)) + r.choice(["", "!"]), random_of(alnum + signs, r.randint(8, 15)), _word(r) + _word(r) + _word(r), f"{_word(r)}-{_word(r)}-{r.randint(10, 999)}"]
        spoken = ["required", "missing", "changed", "invalid", "optional", "expired", "available", "needed", "not-set", "example", "********", "xxxxxxxx", "${TOKEN}", "%s/%s/%s", "here.", "below.", "string", "unknown", "strong.", "wrong."]
        value = r.choice(chosen) if real else r.choice(spoken)
    elif real:
        value = r.choice([hexes, random_of(alnum, r.randint(20, 60)), random_of(alnum[:52], r.randint(20, 40)), "AKIA" + random_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + random_of(alnum, 36), "sk-" + random_of(alnum, 48), "xoxb-" + random_of("0123456789", 12) + "-" + random_of(alnum, 24), base64.b64encode(r.randbytes(r.randint(18, 48))).decode(), "eyJhbGciOiJIUzI1NiJ9." + random_of(alnum + "_-", 40)])
        name = r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential", "client_secret", "access_key", "Authorization", "private_key", "pw"])
        lead = r.choice([f"{name} = ", f'{name}: "', f"{name}=", f'"{name}": "', f"{name} is ", "Bearer ", f"export {name.upper()}=", f"{_word(r)} {name} "])
    else:
        value = r.choice([hexes, _word(r, 14, 22), _word(r, 14, 22).capitalize(), _word(r, 14, 20) + ".", random_of("0123456789", r.randint(16, 24)), f"{_word(r)}_{_word(r)}_{_word(r)}_{r.randint(1, 99)}", f"{_word(r)}/{_word(r)}/{_word(r)}/{r.randint(1, 999)}", f"{_word(r, 8, 14)}-{_word(r)}-{_word(r)}", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}_{r.randint(0, 23):02d}.{r.randint(0, 59):02d}.{r.randint(0, 59):02d}", "=" * r.randint(16, 60), "-" * r.randint(16, 60), "." * r.randint(16, 60), f"www.{_word(r, 8, 14)}.com/{_word(r)}", f"{_word(r, 8, 12)}.{_word(r, 8, 12)}.{_word(r)}", random_of("0123456789", r.randint(4, 9)) + "-" + random_of("0123456789", r.randint(12, 16)), f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}_{r.randint(1024, 65535)}", f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-beta.{r.randint(1, 999)}"])
        lead = r.choice(["commit ", "sha256 ", "sha1: ", "md5sum ", "etag: ", "checksum = ", "digest "]) if value == hexes else r.choice([f"{_word(r)} ", f"{_word(r)}, ", f"see {_word(r)} ", "id ", "https://", "path: ", "version ", "\n", "| "])
        value = value if len(value) >= 16 else value + "_" * (16 - len(value))
    before = " ".join(_word(r) for _ in range(r.randint(0, 5)))
    text = f"{before} {r.choice(['', '### ', '$ '])}{lead}"
    return f"{text}{value}{r.choice([chr(34), ' ', chr(10), ', ', ''])}{_word(r)}", len(text), len(text) + len(value), int(real)


@cache
def trained(seed: int = 11, n: int = FINDINGS) -> Network:
    """Trained on two thirds of n labelled findings and calibrated on the rest. The same seed gives the same network."""
    r = random.Random(seed)
    made = [finding(r) for _ in range(n)]
    seqs, y = [codes(t, a, b) for t, a, b, _ in made], np.array([x[3] for x in made], dtype=float)
    cut, net = 2 * n // 3, Network()
    net.train(seqs[:cut], y[:cut])
    net.calibrate(seqs[cut:], y[cut:])
    net.keep_recall([x[:3] for x in made[cut:] if x[3]])
    return net


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, least_score double"


def scan(text: str, net: Network) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
    """(base spans, those that the network adds, lowest score of a base span). Every candidate is scored; base spans stay whatever their score."""
    base = sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
    more = candidates(text)
    scores = net.score([codes(text, a, b) for a, b in [*((a, b) for _, a, b in base), *more]])
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], dtype=np.int64)) if taken else starts
    added = []
    for (a, b), p in zip(more, scores[len(base) :], strict=True):
        k = int(np.searchsorted(starts, b))
        if p >= net.threshold and not (k and reach[k - 1] > a):
            added.append(("model", a, b))
    return base, added, float(scores[: len(base)].min()) if base else 1.0


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id with counts by kind, a digest of the base spans, and all spans (kind:start:end, code points, comma-joined)."""
    shipped = docs.sparkSession.sparkContext.broadcast(net or trained())  # some 5,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some, rows = b.slice(lo, 512), []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    base, added, least = scan(text, model)
                    every = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                    rows.append((doc, *n, hashlib.sha256(say(base).encode()).hexdigest(), say(every), len(added), least))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(freeing(run), SCANNED)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
