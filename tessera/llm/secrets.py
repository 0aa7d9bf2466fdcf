"""Secret scans: fixed patterns, and a character convolutional network over every span and every other run in its context."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import bounded_sample, cut, small_batches

# The patterns of the base kinds, and what each must reach.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "net")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: What the network judges beside the base spans: longer runs of characters that secrets are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")

AROUND, INSIDE, SYMBOLS = 24, 48, 100


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping in each kind; offsets count code points."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def candidates(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Runs of 12 characters and more, or what base spans leave of them."""
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, _, b in spans:
            if a < m.end() and at < b:
                out.append((at, a))
                at = b
        out.append((at, m.end()))
    return [(a, b) for a, b in out if b - a >= 12]


def runs_of(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    return start[long], end[long]


def worth_reading(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a base span or a candidate: byte tests over the batch, so that the patterns see no others."""
    low = k.lower_ascii(data)
    token = (data >= 0x30) & (data <= 0x39) | ((low >= 0x61) & (low <= 0x7A)) | np.isin(data, np.frombuffer(b"+/_=-", np.uint8))
    start, end = runs_of(token, 12)
    out = np.zeros(len(offsets) - 1, bool)
    first, last = (np.searchsorted(offsets, x, side="right") - 1 for x in (start, end - 1))
    for i, j in zip(first, last, strict=True):  # a run may go on over several texts
        out[i : j + 1] = True
    flat = low.tobytes()
    for word in (*WORDS, b"akia"):
        at = flat.find(word)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, side="right")) - 1
            out[i] = True
            at = flat.find(word, int(offsets[i + 1]))
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Symbol codes of a candidate with its context, INSIDE characters of it at a time; a character inside counts SYMBOLS more."""
    out = []
    for a in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        b = min(end, a + INSIDE)
        own = [min(max(ord(c) - 31, 0), SYMBOLS - 2) for c in text[max(0, a - AROUND) : b + AROUND]]
        left = a - max(0, a - AROUND)
        code = np.zeros(2 * AROUND + INSIDE, np.int64)
        code[AROUND - left : AROUND - left + len(own)] = own
        code[AROUND : AROUND + b - a] += SYMBOLS
        out.append(code)
        if b == end:
            break
    return out


class Network:
    """Embedding, one convolution of width 5, maximum over positions, one output; Adam on the logistic loss, in numpy."""

    def __init__(self, dims: int = 8, filters: int = 24, width: int = 5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.width = width
        self.w = {"e": rng.normal(0, 0.3, (2 * SYMBOLS, dims)), "c": rng.normal(0, 0.2, (width * dims, filters)), "b": np.zeros(filters), "o": rng.normal(0, 0.2, filters), "d": np.zeros(1)}
        self.threshold, self.scale, self.shift = 0.5, 1.0, 0.0

    def forward(self, code: np.ndarray) -> tuple:
        x = self.w["e"][code]
        n = code.shape[1] - self.width + 1
        cols = np.concatenate([x[:, i : i + n] for i in range(self.width)], axis=2)
        z = cols @ self.w["c"] + self.w["b"]
        best = z.argmax(axis=1)
        top = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0], 0)
        return top @ self.w["o"] + self.w["d"][0], top, best, cols

    def logits(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(code[i : i + 256])[0] for i in range(0, len(code), 256))])

    def probability(self, code: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(code) + self.shift, -35, 35)))

    def train(self, code: np.ndarray, label: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> None:
        rng, state, t = np.random.default_rng(5), {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in self.w.items()}, 0
        dims = self.w["e"].shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(code))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                logit, top, best, cols = self.forward(code[at])
                error = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - label[at]) / len(at)
                grad = {"o": top.T @ error, "d": np.array([error.sum()]), "c": np.zeros_like(self.w["c"]), "e": np.zeros_like(self.w["e"])}
                down = error[:, None] * self.w["o"] * (top > 0)  # to the position of each filter's maximum
                grad["b"] = down.sum(axis=0)
                picked = np.take_along_axis(cols, best[:, :, None], 1)
                grad["c"] = np.einsum("bfc,bf->cf", picked, down)
                back = np.einsum("cf,bf->bfc", self.w["c"], down).reshape(len(at), -1, self.width, dims)
                codes = np.stack([np.take_along_axis(code[at], best + j, 1) for j in range(self.width)], axis=2)
                np.add.at(grad["e"], codes.ravel(), back.reshape(-1, dims))
                t += 1
                for n, g in grad.items():
                    m, v = state[n]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[n] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, code: np.ndarray, label: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings; the threshold is the highest that still finds `recall` of them (one half without any)."""
        x = self.logits(code)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -35, 35)))
            self.scale -= 0.2 * float(((p - label) * x).mean() / max(1e-9, (x * x).mean())) * 4
            self.shift -= 0.5 * float((p - label).mean())
        found = np.sort(self.probability(code)[label == 1])
        self.threshold = float(found[min(len(found) - 1, int((1 - recall) * len(found)))]) if len(found) else 0.5


def invented(rng: random.Random, secret: bool) -> str:
    """A made-up finding of the kinds that keys are written in, or a harmless run of characters that looks like one."""
    letters, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    pick = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    word = lambda: pick(lower, rng.randint(3, 8))
    if secret:
        head = rng.choice(["", "", "sk_live_", "ghp_", "glpat-", "xoxb-", "AIza", "key-", "pk_", "eyJ"])
        return head + pick(letters + rng.choice(["", "+/", "_-"]), rng.randint(20, 64)) + rng.choice(["", "", "="])
    return rng.choice([
        f"{word()}_{word()}_{rng.randint(1, 9999)}", f"{word()}-{word()}-{word()}-{rng.randint(1, 99)}", f"/{word()}/{word()}/{word()}{rng.randint(1, 9)}",
        f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", f"{word()}{word()}{rng.randint(1, 99)}", f"{word()}/{word()}/v{rng.randint(1, 9)}-{word()}", f"{word()}={rng.randint(1, 9)}", "A1-" * rng.randint(4, 8), f"{word().upper()}_{word().upper()}_{rng.randint(1, 99)}",
    ])


def unnumbered(rng: random.Random) -> tuple[str, str]:
    """A cue and a made-up key or pass phrase without a digit; the cue is none that the base patterns know, or empty for keys."""
    letters, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"
    pick = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    cue = rng.choice(["passphrase", "pass phrase", "pwd", "credential", "private key", "access key", "auth", "login"]) + rng.choice([": ", " = ", " is ", ' "'])
    if rng.random() < 0.5:
        return rng.choice(["", cue]), pick(letters + rng.choice(["", "+/", "_-"]), rng.randint(20, 64))
    if rng.random() < 0.5:
        return cue, pick(lower, rng.randint(16, 40))
    return cue, rng.choice("-_").join(pick(lower, rng.randint(3, 8)) for _ in range(rng.randint(4, 6)))


def base_windows(text: str, a: int, kind: str, b: int) -> list[np.ndarray]:
    """Windows of a base span; of an assignment, of its value."""
    own = ASSIGN.match(text, a) if kind == "assign" else None
    return windows(text, own.start(2) if own else a, b)


@dataclass
class Scanner:
    network: Network

    def scan(self, texts: list[str]) -> list[list[tuple[int, str, int, float]]]:
        """All spans (start, kind, end, probability) of each text, base ones first at equal starts.

        The network judges every base span and candidate, and decides the candidates; base spans stay whatever it says.
        """
        spans, rows = [], []
        for i, text in enumerate(texts):
            base = base_spans(text)
            for a, kind, b in base:
                spans.append((i, a, kind, b))
                rows.append(base_windows(text, a, kind, b))
            for a, b in candidates(text, base):
                spans.append((i, a, "net", b))
                rows.append(windows(text, a, b))
        out: list[list] = [[] for _ in texts]
        if spans:
            p = self.network.probability(np.stack([w for ws in rows for w in ws]))
            best = np.maximum.reduceat(p, np.concatenate([[0], np.cumsum([len(ws) for ws in rows])])[:-1])
            for (i, a, kind, b), x in zip(spans, best.tolist(), strict=True):
                if kind != "net" or x >= self.network.threshold:
                    out[i].append((a, kind, b, x))
        return [sorted(x, key=lambda s: (s[0], KINDS.index(s[1]), s[2])) for x in out]


def findings(rows: DataFrame) -> DataFrame:
    """(at, label, code, parts, context) of the spans and runs of rows(key, text), one row for each window and one for a context of each text.

    label 1: a window of a base span. label 0: a window of another run, with its letter parts in lower case (parts is null where
    the run has five digits in a row or more). context: up to 60 characters before a word that a hash chooses among all of the
    text's words. `at` orders the rows at random, by a hash of text and place.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in k.column(batch, "text").to_pylist():
                own = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
                order = lambda *place: int.from_bytes(hashlib.blake2b(repr(place).encode(), key=own, digest_size=8).digest(), "little", signed=True)  # noqa: B023, E731
                spans = base_spans(text)
                for a, kind, b in spans:
                    out += [(order("base", a, kind, i), 1, w.astype(np.uint8).tobytes(), [], None) for i, w in enumerate(base_windows(text, a, kind, b))]
                for a, b in candidates(text, spans):
                    parts = None if re.search(r"[0-9]{5}", text[a:b]) else sorted({x.lower() for x in re.findall("[A-Za-z]+", text[a:b])})
                    out += [(order("run", a, i), 0, w.astype(np.uint8).tobytes(), parts, None) for i, w in enumerate(windows(text, a, b))]
                words = [m.start() for m in re.finditer(r"\S{3,}", text)]
                if words:
                    at = words[order("context") % len(words)]
                    out.append((order("context", at), None, None, None, text[max(0, at - 60) : at].strip()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["at", "label", "code", "parts", "context"])

    return rows.select("text").mapInArrow(emit, "at long, label int, code binary, parts array<string>, context string")


def harmless(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(at, code) of the runs of `found` that are words: each letter part is a word of at least two texts of rows. Other runs stay unlabelled."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![0-9a-z_+/=-])[a-z]+(?![0-9a-z_+/=-])"), F.lit(0)))).alias("part")
    known = rows.select(word).groupBy("part").agg(F.count("*").alias("n")).where("n >= 2").select("part")
    runs = found.where("label = 0 and size(parts) > 0").select("at", "code", F.explode("parts").alias("part"), F.size("parts").alias("n"))
    return runs.join(known, "part").groupBy("at", "code").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m = n").select("at", "code")


def fit(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", bound: int = 4_000, examples: int = 3_000, recall: float = 0.98) -> Scanner:
    """Train on labelled findings in texts of about `bound` rows, chosen by a hash of key_col.

    Nobody has labelled findings of these tables. Positive are base findings and invented keys and pass phrases (with and without
    a digit), negative invented harmless runs and the sample's runs that consist of its words (see harmless); what else stands in
    the texts is not labelled. Of the sample's windows of either kind, `examples` chosen by a hash reach the driver, and as many
    invented ones beside them (half of them keys with a digit or harmless runs each, and as many keys and phrases without a digit),
    in contexts from the sample; a fifth is held out to calibrate the scores and to set the threshold.
    """
    rows = cut(bounded_sample(docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where("text is not null"), F.col("key"), bound).select("text").repartition(16))  # a bounded sample: few files
    all_found = cut(findings(rows))
    codes = lambda df: [np.frombuffer(r["code"], np.uint8).astype(np.int64) for r in df.select("at", "code").orderBy("at", "code").limit(examples).collect()]
    found, other = codes(all_found.where("label = 1")), codes(harmless(all_found, rows))
    context = [r["context"] for r in all_found.where("context is not null").select("at", "context").orderBy("at", "context").limit(examples).collect()] or [" "]
    rng = random.Random(11)
    for i in range(examples):  # beside what the tables gave
        own = invented(rng, i % 2 == 0)
        before, after = rng.choice(context), rng.choice(context)
        (found if i % 2 == 0 else other).append(windows(f"{before} {own} {after}", len(before) + 1, len(before) + 1 + len(own))[0])
        if i % 2 == 0:
            cue, own = unnumbered(rng)
            before = f"{rng.choice(context)} {cue}"
            found.append(windows(f"{before}{own} {rng.choice(context)}", len(before), len(before) + len(own))[0])
    code = np.stack(found + other)
    label = np.concatenate([np.ones(len(found)), np.zeros(len(other))])
    order = np.random.default_rng(7).permutation(len(code))
    hold, own = order[: len(order) // 5], order[len(order) // 5 :]
    network = Network()
    network.train(code[own], label[own])
    network.calibrate(code[hold], label[hold], recall)
    return Scanner(network)


def scan(df: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """Each row inside `row` (no name can clash), with `spans`, an array of (start, kind, end, score) in code points, over its whole text.

    Kinds are assign, access and hex by pattern, net by the network, which gives every span its probability; net spans overlap
    no other. A null text counts as empty. The network (a few kB) is broadcast. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(scanner)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    kind = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf("array<struct<start:int,kind:string,end:int,score:double>>")
    def spans(text: pa.Array) -> pa.Array:
        data, offsets = k.bytes_of(text)
        out: list[list] = [[] for _ in range(len(text))]
        for a, b in k.pieces(offsets, 1 << 20):
            some = a + np.flatnonzero(worth_reading(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in some]
            for i, found in zip(some, shared.value.scan(texts), strict=True):
                out[i] = [{"start": s, "kind": kind, "end": e, "score": p} for s, kind, e, p in found]
        k.rest()
        return pa.array(out, pa.list_(kind))

    return packed.select("row", spans("text").alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, spans as text (kind:start:end, comma-joined) and scores, their probabilities
    with four decimals in the same order, to scanned rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "net")
    return scanned.select("row", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_string("%.4f", s["score"])), ",").alias("scores"))


def empty_digest() -> str:
    """base_sha256 of a text without spans."""
    return hashlib.sha256(b"").hexdigest()
