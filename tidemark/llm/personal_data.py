"""Personal data: pattern spans, and more spans by a character BiLSTM with CRF transitions.

The pattern rules are exact. The model is a bidirectional LSTM over characters whose tag scores go through a
linear-chain CRF; it is trained in numpy on labelled spans. These are spans of the rules in their surroundings,
and the same surroundings with the span rewritten in a form that the rules do not know: addresses that are
spelled out or in brackets, numbers with other marks between their parts, or without the leading plus. So
the model learns to see a kind by its shape and its context, and finds what the rules miss.

Texts are decoded in overlapping windows of fixed length, and every character takes its tag from the window in
which it lies farthest from an edge, so the decision does not depend on where a text is cut. A window is
decoded when it holds an @, an "at" or "dot" in brackets, a spelled-out "dot", or at least ``DIGITS`` digits:
:func:`_possible` admits no span without one of these, so the others need no decoding. Model spans that touch
a pattern span are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, HOP = 96, 48
DIGITS = 4
#: Labelled windows that the model is trained on, at most; and documents that they come from.
TRAIN_WINDOWS, TRAIN_ROWS = 2400, 15_000
#: Labelled spans of one row that the training takes.
ROW_SPANS = 8
EMBED, HIDDEN = 10, 20

Span = tuple[str, int, int]

# The patterns of the four kinds, in their order.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[(\[{](?:at|dot)[)\]}]| dot ", re.I)
# What a span of the model must look like to be of its kind.
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(@|[(\[{]at[)\]}]|\bat\b) ?[A-Za-z0-9-]+( ?(\.|[(\[{]dot[)\]}]|\bdot\b) ?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}([^A-Za-z0-9]{1,3}[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]([^A-Za-z0-9]{0,2}[0-9])+"),
    "phone": re.compile(r"[+(]{0,2}[0-9][0-9 ().+/-]*[ ().+/-][0-9 ().+/-]*[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards so that long runs of letters cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    return out


def pattern_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the pattern rules, by kind and start; positions are code points."""
    out = _emails(text) if "@" in text else []
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _char_classes() -> tuple[np.ndarray, int]:
    """ASCII characters keep a class each (letters without case, one class for all digits); the rest share two."""
    table = np.zeros(128, dtype=np.int64)
    for i in range(128):
        c = chr(i).lower()
        table[i] = 3 if c.isdigit() else ord(c) - 28 if c > " " else 2
    return table, 128


_CLASSES, VOCABULARY = _char_classes()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(points < 128, _CLASSES[np.minimum(points, 127)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """BiLSTM-CRF; parameters are plain arrays, gradients are written out by hand."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {"emb": init(VOCABULARY, EMBED), "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(EMBED, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.p["bias"][0] = 2

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, hidden) of direction ``d`` for character classes (batch, time)."""
        n, t = x.shape
        table = self.p["emb"] @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((t, n, HIDDEN), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[:, i]] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN :])
            a, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, last = c, h
            c = f * c + a * new
            squashed = np.tanh(c)
            h = o * squashed
            out[i] = h
            if keep:
                trace.append((i, a, f, o, new, before, squashed, last))
        return out, trace

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time, batch, tags)."""
        both = np.concatenate((self._run(x, "f", False)[0], self._run(x, "b", False)[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag paths (batch, time) under the CRF."""
        s = self.scores(x)
        t, n, _ = s.shape
        move = self.p["move"]
        best, back = s[0], np.zeros((t, n, TAGS), dtype=np.int8)
        for i in range(1, t):
            all_ = best[:, :, None] + move[None]
            back[i] = all_.argmax(axis=1)
            best = all_.max(axis=1) + s[i]
        out = np.zeros((n, t), dtype=np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i][rows, out[:, i]]
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of the tag paths ``y``."""
        p, (n, t) = self.p, x.shape
        hf, tf = self._run(x, "f", True)
        hb, tb = self._run(x, "b", True)
        both = np.concatenate((hf, hb), axis=2)
        s = both @ p["out"] + p["bias"]
        move = p["move"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + move[None], 1) + s[i]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(move[None] + (s[i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        ds = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + move + (s[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds[np.arange(t)[:, None], np.arange(n)[None], y.T] -= 1
        ds /= n
        g = {"move": pair / n, "out": np.einsum("tnh,tnk->hk", both, ds), "bias": ds.sum(axis=(0, 1)), "emb": np.zeros_like(p["emb"])}
        dboth = ds @ p["out"].T
        for d, trace, part in (("f", tf, dboth[:, :, :HIDDEN]), ("b", tb, dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            dtable, gh = np.zeros((VOCABULARY, 4 * HIDDEN), np.float32), np.zeros_like(p[f"h{d}"])
            for i, a, f, o, new, before, squashed, last in reversed(trace):
                dh = dh + part[i]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate((dc * new * a * (1 - a), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * a * (1 - new**2)), axis=1)
                np.add.at(dtable, x[:, i], dz)
                gh += last.T @ dz
                dh, dc = dz @ p[f"h{d}"].T, dc * f
            g |= {f"h{d}": gh, f"x{d}": p["emb"].T @ dtable, f"c{d}": dtable.sum(axis=0)}
            g["emb"] += dtable @ p[f"x{d}"].T
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 320, batch: int = 40, rate: float = 0.02, seed: int = 5) -> Tagger:
        """Adam over shuffled batches. ``x``: character classes, ``y``: tags, both (windows, time)."""
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        while step < steps and len(x):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                step += 1
                own = order[lo : lo + batch]
                for k, g in self._gradients(x[own], y[own]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (1 - 0.9 * min(1.0, step / steps)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def windows(text: str) -> np.ndarray:
    """Starts of the windows that could hold a span, out of all overlapping windows of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    digits = np.concatenate(([0], np.cumsum((points >= 48) & (points <= 57))))
    marked = points == 64
    marked[[m.start() for m in _SPELLED.finditer(text)]] = True
    ats = np.concatenate(([0], np.cumsum(marked)))
    starts = np.arange(0, max(1, len(points) - WINDOW + HOP), HOP) if len(points) > WINDOW else np.array([0])
    ends = np.minimum(starts + WINDOW, len(points))
    return starts[(digits[ends] - digits[starts] >= DIGITS) | (ats[ends] > ats[starts])]


def tags_of(spans: list[Span], start: int, length: int = WINDOW) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        lo, hi = max(a - start, 0), min(b - start, length)
        if lo < hi:
            out[lo:hi] = k + 1
            if a >= start:
                out[lo] = k
    return out


def window_codes(text: str, starts: np.ndarray) -> np.ndarray:
    """Character classes of the windows, padded with class 0."""
    x = np.concatenate((codes(text), np.zeros(WINDOW, dtype=np.int64)))
    return x[starts[:, None] + np.arange(WINDOW)]


def rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """``text`` with each labelled span in a form that the pattern rules do not take, and where the spans are then."""
    out, moved, at = [], [], 0

    def pick(*choices: str) -> str:
        return choices[int(rng.integers(len(choices)))]

    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        body = text[a:b]
        if kind == "email":
            mark, dot = (pick(" at ", "(at)", " (at) ", "[at]", " [at] ", " @ "), pick(" dot ", "(dot)", " [dot] "))
            name, _, host = body.partition("@")
            body = name + mark + (host.replace(".", dot) if "@" not in mark or rng.random() < 0.5 else host)
        elif kind == "ip":
            body = body.replace(".", pick(" . ", ",", "-", "[.]", ":"))
        elif kind == "card":
            digits = re.sub("[^0-9]", "", body)
            body = pick(".", "/", "_", "  ", " - ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            digits = re.sub("[^0-9]", "", body)
            head, rest = digits[:-10], digits[-10:]
            gap = pick(" ", "-", ".", "/")
            body = pick("", f"00{head} ", f"({head}) " if head else "") + gap.join((rest[:3], rest[3:6], rest[6:])) if rng.random() < 0.6 else f"({rest[:3]}) {rest[3:6]}{gap}{rest[6:]}"
        out.append(text[at:a])
        start = sum(map(len, out))
        out.append(body)
        moved.append((kind, start, start + len(body)))
        at = b
    return "".join([*out, text[at:]]), moved


def train(labelled: list[tuple[str, list[Span]]], limit: int = TRAIN_WINDOWS, seed: int = 3) -> Tagger:
    """A tagger from texts with labelled spans: windows with a span, as they are and rewritten, and windows without one."""
    full, bare, rng = [], [], np.random.default_rng(seed)
    for text, spans in labelled:
        for own, marks in ((text, spans), rewritten(text, spans, rng), rewritten(text, spans, rng)) if spans else ((text, spans),):
            starts = windows(own)
            for s, x in zip(starts.tolist(), window_codes(own, starts), strict=True):
                y = tags_of(marks, s)
                (full if y.any() else bare).append((x, y))
    full = [full[i] for i in rng.permutation(len(full))[: limit * 2 // 3]]
    bare = [bare[i] for i in rng.permutation(len(bare))]
    pick = full + bare[: max(limit // 3, min(limit - len(full), len(full) // 2))]
    return Tagger().fit(np.array([x for x, _ in pick]), np.array([y for _, y in pick])) if full else Tagger()


def reconciled(length: int, starts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One tag per character, from the window in which the character is farthest from an edge."""
    out, depth = np.zeros(length, dtype=np.int8), np.full(length, -1, dtype=np.int64)
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for s, own in zip(starts.tolist(), tags, strict=True):
        n = min(WINDOW, length - s)
        d = inner[:n].copy()
        if s == 0:
            d[: WINDOW // 2] = WINDOW  # no edge before the first character
        if s + WINDOW >= length:
            d[WINDOW // 2 :] = WINDOW
        better = d > depth[s : s + n]
        out[s : s + n][better] = own[:n][better]
        depth[s : s + n][better] = d[better]
    return out


def _possible(kind: str, body: str) -> bool:
    """Whether a span of the model can be of its kind: it has the kind's shape, and its number checks hold."""
    if not _SHAPES[kind].fullmatch(body):
        return False
    if kind == "email":
        return "@" in body or _SPELLED.search(body) is not None
    digits = re.findall("[0-9]+", body)
    if kind == "ip":
        return all(int(x) <= 255 for x in digits) and sum(map(len, digits)) >= DIGITS
    number = "".join(digits)
    return 9 <= len(number) <= 15 if kind == "phone" else 13 <= len(number) <= 19 and _luhn(number)


def spans_of(tags: np.ndarray, text: str) -> list[Span]:
    """Spans that a tag sequence spells out, without those that cannot be of their kind."""
    out, i, n = [], 0, len(tags)
    hits = np.flatnonzero(tags)
    while len(hits) and i < n:
        at = int(np.searchsorted(hits, i))
        if at == len(hits):
            break
        i = int(hits[at])
        kind = (int(tags[i]) - 1) // 2
        j = i + 1
        while j < n and tags[j] == 2 * kind + 2:
            j += 1
        a, b = i, j
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        body = text[a:b]
        if a < b and _possible(KINDS[kind], body):
            out.append((KINDS[kind], a, b))
        i = j
    return out


def find_spans(texts: list[str], tagger: Tagger, batch: int = 4096) -> Iterator[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text; windows of many texts are decoded together."""
    todo = [windows(t) if t else np.zeros(0, dtype=np.int64) for t in texts]
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(todo[hi]) <= batch):
            held += len(todo[hi])
            hi += 1
        own = [window_codes(texts[i], todo[i]) for i in range(lo, hi)]
        x = np.concatenate(own) if own else np.zeros((0, WINDOW), dtype=np.int64)
        tags = np.concatenate([tagger.decode(x[k : k + batch]) for k in range(0, len(x), batch)]) if len(x) else np.zeros((0, WINDOW), dtype=np.int8)
        at = 0
        for i in range(lo, hi):
            base = pattern_spans(texts[i])
            n = len(todo[i])
            more: list[Span] = []
            if n:
                own_tags = reconciled(len(texts[i]), todo[i], tags[at : at + n])
                more = [s for s in spans_of(own_tags, texts[i]) if not any(s[1] < b and a < s[2] for _, a, b in base)]
                at += n
            yield base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
        lo = hi


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (pattern and model spans).

    Null and empty texts have no spans; very long texts are searched whole, window by window. Ties between
    spans do not arise, as those of the model touch none of the rules. Repeated rows are searched each; other
    columns, whatever their names, are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for base, all_ in find_spans(texts, tagger):
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    form = f"`{id_col}` bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, form)


def learn_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Tagger:
    """A tagger from about ``train_rows`` rows that a hash of the id chooses, labelled by the pattern rules (see :func:`train`).

    Of each chosen text only the surroundings of its labelled spans, and one other window, reach the driver.
    """
    size = docs.count()
    unit = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    chosen = docs.where(unit < F.lit(min(1.0, train_rows / max(size, 1)))).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int | None, str, str]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = pattern_spans(text or "")
                for kind, a, b in spans[:ROW_SPANS]:
                    lo, hi = max(0, a - WINDOW // 2), b + WINDOW // 2
                    near = [(k, x - lo, y - lo) for k, x, y in spans if lo <= x and y <= hi]
                    out.append((doc, text[lo:hi], joined(near)))
                starts = windows(text or "")
                if len(starts) and not spans:
                    s = int(starts[len(starts) // 2])
                    out.append((doc, text[s : s + WINDOW], ""))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["id", "text", "spans"])

    got = chosen.mapInArrow(label, "id bigint, text string, spans string").orderBy("id", "text", "spans").limit(4 * TRAIN_WINDOWS).collect()

    def parsed(spans: str) -> list[Span]:
        return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]

    return train([(r.text, parsed(r.spans)) for r in got])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_personal_data(docs, learn_tagger(docs))
