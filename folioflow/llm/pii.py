"""PII: a character BiLSTM with CRF transitions beside exact patterns."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import bound_batches, mix, table, u64

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: A pattern span of any kind holds one of these characters.
TRIGGER = re.compile(r"[0-9@]")
#: Digits are taken all or none: a match always begins where a run of digits does and ends where one does, so no other start or length can match, and time is linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    digits = re.sub(r"[^0-9]+", "", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain.domain in linear time: from each @ back to where a match may begin."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and non-overlapping for each kind; those that fail a check are dropped."""
    if not TRIGGER.search(text):
        return []
    out = list(emails(text))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return in_order(out)


def in_order(spans: Sequence[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def digest_form(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the tagger ----------------------------------------------------------

#: Windows of training and of search. A search window decides its middle STRIDE characters; those beside them, MARGIN on either side, are context.
WIDTH, SEARCH_WIDTH, MARGIN = 64, 256, 16
STRIDE = SEARCH_WIDTH - 2 * MARGIN
TAGS = 1 + 2 * len(KINDS)
_SIGNS = "@.+-()_% \n,:;/\"'=#[]{}<>|*!?&$"
SYMBOLS = 4 + 26 + len(_SIGNS)


def symbol_table() -> np.ndarray:
    """Character to symbol: 0 beyond the text, 1 others, 2 digits, 3 letters that aren't ASCII, then a-z in either case, then signs."""
    t = np.ones(256, np.int64)
    t[48:58] = 2
    for i in range(26):
        t[97 + i] = t[65 + i] = 4 + i
    for i, c in enumerate(_SIGNS):
        t[ord(c)] = 30 + i
    t[192:256] = 3
    return t


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 256, table[np.minimum(c, 255)], 3)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def stepped(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp(x), along rows, by positive weights."""
    m = x.max(1, keepdims=True)
    return m + np.log(np.exp(x - m) @ weights)


#: Slope of the hard sigmoid, with which gates open: 0 up to -2.5, 1 from 2.5, and a line between.
SLOPE = np.float32(0.2)


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(SLOPE * x + np.float32(0.5), np.float32(0), np.float32(1))


def gate_slope(s: np.ndarray) -> np.ndarray:
    """The derivative of gate() where its value is s."""
    return SLOPE * ((s > 0) & (s < 1)).astype(np.float32)


class Tagger:
    """Two LSTMs with hard sigmoid gates over the characters, one from each end, a linear layer, and a CRF over B/I tags."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        h = self.hidden = hidden
        small = lambda *s: (r.normal(size=s) / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"out": small(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.w |= {f"{d}x": 0.3 * small(SYMBOLS, 4 * h) * np.sqrt(SYMBOLS).astype(np.float32), f"{d}h": small(h, 4 * h), f"{d}b": np.repeat(np.array([0, 1, 0, 0], np.float32), h)}
        allowed = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):  # I of a kind follows B or I of that kind
            allowed[:, 2 + 2 * k] = -30
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.allowed = allowed

    def lstm(self, x: np.ndarray, d: str, keep: bool = False):  # noqa: ANN201
        h_, w = self.hidden, self.w
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h, c = np.zeros((len(x), h_), np.float32), np.zeros((len(x), h_), np.float32)
        out, tape = np.zeros((x.shape[1], len(x), h_), np.float32), []
        table = w[f"{d}x"] + w[f"{d}b"]
        for t in steps:
            z = table[x[:, t]] + h @ w[f"{d}h"]
            s = gate(z[:, : 3 * h_])
            i, f, o, g = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :], np.tanh(z[:, 3 * h_ :])
            c_new = f * c + i * g
            u = np.tanh(c_new)
            if keep:
                tape.append((t, i, f, o, g, c, u, h))
            h, c = o * u, c_new
            out[t] = h
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, window, tag) for symbols x (window, time).

        As lstm() and the linear layer, but both directions step together. The
        slopes of the gates and their middles are in the weights, so that a gate
        is cut at 0 and 1 and no more; tanh(z) is 2 / (1 + exp(-2 z)) - 1, which
        costs numpy less where it has no 512-bit instructions. h is half of the
        state, and c -2 times it. Gates lie apart, and outputs by time, tag and
        window, so that loops over them are long.
        """
        h_, w, n, steps = self.hidden, self.w, len(x), x.shape[1]
        turn, middle = np.repeat(np.array([SLOPE, SLOPE, SLOPE, -2], np.float32), h_), np.repeat(np.array([0.5, 0.5, 0.5, 0], np.float32), h_)
        by_gate = lambda v: np.ascontiguousarray(np.stack(np.split(v, 4, axis=-1)), np.float32)
        table = by_gate(np.concatenate([(w[f"{d}x"] + w[f"{d}b"]) * turn + middle for d in "fb"])).reshape(-1, h_)
        inner = by_gate(np.stack([w[f"{d}h"] * turn * 2 for d in "fb"]))
        part = np.ascontiguousarray((w["out"].reshape(2, h_, TAGS) * 2).transpose(0, 2, 1), np.float32)
        x = np.ascontiguousarray(x.T, np.intp)
        asked, shift = np.concatenate([x, x[::-1] + SYMBOLS], 1), 2 * SYMBOLS * np.arange(4)[:, None]
        h, c, v = np.zeros((3, 2, n, h_), np.float32)
        z, more = np.empty((2, 4, 2, n, h_), np.float32)
        (i, f, o, g), gates, rows, at = z, z[:3], z.reshape(4, 2 * n, h_), np.empty((4, 2 * n), np.intp)
        out, turned = np.empty((2, steps, TAGS, n), np.float32), h.transpose(0, 2, 1)
        with np.errstate(over="ignore"):  # exp(-2 z) of a very small z is infinite, and tanh(z) -1
            for t in range(steps):
                np.add(asked[t], shift, out=at)
                np.take(table, at, axis=0, out=rows, mode="clip")
                np.matmul(h, inner, out=more)
                z += more
                np.clip(gates, 0, 1, out=gates)
                np.exp(g, out=g)
                g += 1
                np.divide(-4, g, out=g)
                g += 2  # -2 tanh(z)
                g *= i
                c *= f
                c += g
                np.exp(c, out=v)
                v += 1
                np.divide(1, v, out=h)
                h -= 0.5
                h *= o
                np.matmul(part, turned, out=out[:, t])
        e = out[0]
        e += out[1, ::-1]
        e += w["bias"][:, None]
        return e.transpose(0, 2, 1)

    def all_plain(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path is surely tag 0 throughout.

        Scores of the tags B and I of each kind are kept relative to the path of
        tag 0 alone. A B may follow any other kind at the best of their steps,
        and steps back to 0 are the best there are, which can only flatter these
        paths; if none ever gains on the plain one, it is the best.
        """
        step, start = self.w["step"] + self.allowed, self.w["start"] + self.allowed[0]
        step = step - step[0, 0]
        opens, goes = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter, cross, leave = step[0, opens], step[1:, opens].max(0), float(step[1:, 0].max())
        first_on, on = step[opens, goes][:, None], step[goes, goes][:, None]
        enter, cross = enter[:, None], cross[:, None]
        lead = np.ascontiguousarray((e[:, :, 1:] - e[:, :, :1]).transpose(0, 2, 1))
        b, i = lead[0, ::2] + (start[opens] - start[0])[:, None], lead[0, 1::2] + (start[goes] - start[0])[:, None]
        top, most = np.empty_like(b), np.empty((len(e), e.shape[1]), b.dtype)
        for t in range(1, len(e)):
            np.maximum(b, i, out=top)
            before = np.maximum.reduce(top, 0, out=most[t - 1])
            b += first_on
            i += on
            np.maximum(b, i, out=i)
            i += lead[t, 1::2]
            np.add(before, cross, out=b)
            np.maximum(b, enter, out=b)
            b += lead[t, ::2]
        most[:-1] += leave
        np.maximum(b, i).max(0, out=most[-1])
        return most.max(0) < -1e-3

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log-sums of the CRF, and its log-partition."""
        step = np.exp(self.w["step"] + self.allowed)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + self.w["start"] + self.allowed[0]
        for t in range(1, len(e)):
            a[t] = e[t] + stepped(a[t - 1], step)
        for t in range(len(e) - 2, -1, -1):
            b[t] = stepped(e[t + 1] + b[t + 1], step.T)
        return a, b, lse(a[-1], 1)

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, their marginals), each (time, window); windows of tag 0 alone are not summed, and have 1."""
        step, v = self.w["step"] + self.allowed, (e[0] + self.w["start"] + self.allowed[0]).T
        rows, back = np.arange(e.shape[1]), np.zeros((len(e), TAGS, e.shape[1]), np.int8)
        open_to, goes = np.append(0, np.arange(1, TAGS, 2)), np.arange(2, TAGS, 2)  # I follows its own B or I alone
        into = step[:, open_to, None]
        for t in range(1, len(e)):
            new = np.empty_like(v)
            stay, begun = v[goes] + step[goes, goes][:, None], v[goes - 1] + step[goes - 1, goes][:, None]
            new[goes], back[t, goes] = np.maximum(stay, begun), np.where(begun > stay, goes[:, None] - 1, goes[:, None])
            paths = v[:, None] + into
            new[open_to], back[t, open_to] = paths.max(0), paths.argmax(0)
            v = new + e[t].T
        tag = v.argmax(0)
        path = [tag]
        for t in range(len(e) - 1, 0, -1):
            tag = back[t, tag, rows]
            path.append(tag)
        tags, sure = np.stack(path[::-1]), np.ones(e.shape[:2], e.dtype)
        if len(some := np.flatnonzero(tags.any(0))):
            a, b, z = self.sums(e[:, some])
            marginal = np.exp(a + b - z[None, :, None])
            sure[:, some] = np.take_along_axis(marginal, tags[:, some, None], 2)[:, :, 0]
        return tags, sure

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of tags y (window, time) for symbols x."""
        w, h_, n = self.w, self.hidden, len(x)
        (hf, tape_f), (hb, tape_b) = self.lstm(x, "f", True), self.lstm(x, "b", True)
        both = np.concatenate([hf, hb], 2)
        e = both @ w["out"] + w["bias"]
        a, b, z = self.sums(e)
        de = np.exp(a + b - z[None, :, None])
        step = w["step"] + self.allowed
        g = {k: np.zeros_like(v) for k, v in w.items()}
        for t in range(1, len(e)):
            pair = np.exp(a[t - 1][:, :, None] + step + (e[t] + b[t])[:, None, :] - z[:, None, None])
            g["step"] += pair.sum(0)
            np.add.at(g["step"], (y[:, t - 1], y[:, t]), -1)
        g["start"] += de[0].sum(0)
        np.add.at(g["start"], y[:, 0], -1)
        de = de - np.eye(TAGS, dtype=np.float32)[y.T]
        g["out"], g["bias"] = np.einsum("tnh,tnk->hk", both, de), de.sum((0, 1))
        dh_all = de @ w["out"].T
        for d, tape, part in (("f", tape_f, dh_all[:, :, :h_]), ("b", tape_b, dh_all[:, :, h_:])):
            dh, dc = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            for t, i, f, o, gg, c, u, h in reversed(tape):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - u * u)
                dz = np.concatenate([dc * gg * gate_slope(i), dc * c * gate_slope(f), dh * u * gate_slope(o), dc * i * (1 - gg * gg)], 1)
                g[f"{d}h"] += h.T @ dz
                g[f"{d}b"] += dz.sum(0)
                np.add.at(g[f"{d}x"], x[:, t], dz)
                dh, dc = dz @ w[f"{d}h"].T, dc * f
        return {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.04, seed: int = 3) -> Tagger:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for s in range(1, steps + 1):
            some = r.integers(0, len(x), batch)
            speed = rate * min(1, 2 * (1 - s / (steps + 1)))
            for k, g in self.gradient(x[some], y[some]).items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (speed * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)
        return self


# ---- training data -------------------------------------------------------


def tags_of(spans: Sequence[Span], n: int) -> np.ndarray:
    t = np.zeros(n, np.int64)
    for kind, a, b in spans:
        if not t[a:b].any():
            k = KINDS.index(kind)
            t[a:b] = 2 + 2 * k
            t[a] = 1 + 2 * k
    return t


def made_up(n: int, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Seeded examples: each kind in several shapes, and number-like text that is none."""
    r = np.random.default_rng(seed)
    pick = lambda *a: a[r.integers(len(a))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(pick(*"aeiou") + pick(*"bdlmnrst") for _ in range(r.integers(1, 4)))

    def card() -> str:
        d = digits(int(r.integers(13, 19)))
        d += next(x for x in "0123456789" if luhn(d + x))
        return pick(d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4)), ".".join(d[i : i + 4] for i in range(0, len(d), 4)))

    def ip() -> str:
        a, b, c, d = (str(x) for x in r.integers(0, 256, 4))
        return pick(f"{a}.{b}.{c}.{d}", f"{a}.{b}.{c}.{d}", f"{a}.{b}.{c}[.]{d}", f"{a}[.]{b}[.]{c}[.]{d}")

    def email() -> str:
        name, host, end = f"{word()}{pick('.', '', '_')}{pick(word(), digits(2), '')}".strip("._"), f"{word()}{pick('', digits(1))}", pick("com", "org", "net", "co")
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "."), ("(at)", "(dot)"))
        return f"{name}{at}{host}{dot}{pick(end, f'{word()}{dot}{end}')}"

    shapes = {
        "email": email,
        "ip": ip,
        "card": card,
        "phone": lambda: pick(f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"),
    }
    none = [
        lambda: f"{digits(1)}.{digits(1)}", lambda: digits(int(r.integers(1, 9))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f'"{"".join(pick(*"0123456789abcdef") for _ in range(32))}"',
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.999", lambda: f"@{word()}", lambda: f"{digits(2)}, {digits(3)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"{word()} at {word()}", lambda: f"{word()} ({word()})", lambda: f"[{digits(2)}]",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WIDTH:
            roll = r.random()
            if roll < 0.16:
                kind = pick(*KINDS)
                spans.append((kind, len(text), len(text) + len(x := shapes[kind]())))
                text += x
            else:
                text += none[r.integers(len(none))]() if roll < 0.3 else word()
            text += pick(" ", " ", " ", ", ", ". ", "\n")
        out.append((text, spans))
    return out


def window_starts(text: str, most: int, step: int = WIDTH // 2) -> list[int]:
    """Where the training windows of a text begin, the first ones before it: all that hold a digit or @, at most `most`, and a quarter of `most` others.

    Of more, those with the least hashes of text and place go, wherever they lie.
    """
    holds = {max(0, m.start() + MARGIN - WIDTH // 2) // step for m in TRIGGER.finditer(text)}
    seed, out = u64(zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32), []
    for some, n in ((sorted(holds), most), (sorted({*range(max(1, len(text) // step))} - holds), most // 4)):
        out += [some[i] for i in np.argsort(mix(np.array(some, np.uint64) ^ seed), kind="stable")[:n]]
    return [k * step - MARGIN for k in sorted(out)]


def windows_of(examples: Sequence[tuple[str, list[Span]]], max_windows: int = 8) -> tuple[np.ndarray, np.ndarray]:
    table, x, y = symbol_table(), [], []
    for text, spans in examples:
        s, t = (np.pad(v, (MARGIN, WIDTH)) for v in (symbols(text, table), tags_of(spans, len(text))))
        for at in window_starts(text, max_windows):
            a, b = s[at + MARGIN :][:WIDTH], t[at + MARGIN :][:WIDTH].copy()
            for k in range(len(KINDS)):  # a span that began before the window begins with it
                if b[0] == 2 + 2 * k:
                    b[0] -= 1
            x.append(a)
            y.append(b)
    return (np.stack(x), np.stack(y)) if x else (np.zeros((0, WIDTH), np.int64), np.zeros((0, WIDTH), np.int64))


def fit(docs: DataFrame, max_documents: int = 400, made: int = 1500, max_windows: int = 8, **options) -> Tagger:
    """Train on the pattern spans of at most max_documents different texts with digits or @, first by a hash, and on seeded examples.

    A text gives at most max_windows windows of WIDTH characters with a digit or
    @ and a quarter of that without, chosen by a hash over the whole of it.
    Equal windows count once, before they come to the driver: repeated rows add
    nothing, whatever their number.
    """
    h = F.struct(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i"))
    some = docs.where(F.col("text").rlike("[0-9@]")).select(h.alias("h")).distinct().orderBy("h").limit(max_documents)
    rows = docs.select("text").join(F.broadcast(some), h == F.col("h")).select("text")  # two numbers a row, max_documents at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = windows_of([(t, base_spans(t)) for t in batch.column("text").to_pylist()], max_windows)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.int64())), pa.array(list(y), pa.list_(pa.int64()))], names=["x", "y"])

    got = rows.mapInArrow(cut, "x array<long>, y array<long>").distinct().toArrow()
    pairs = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))
    x, y = windows_of(made_up(made), WIDTH)
    if pairs:
        x, y = np.concatenate([x, np.array([p[0] for p in pairs])]), np.concatenate([y, np.array([p[1] for p in pairs])])
    return Tagger(**options).train(x, y)


# ---- search --------------------------------------------------------------


#: Ways to write @ and . that readers undo: in brackets, or as words between blanks.
_AT, _DOT = re.compile(r" ?[\[(](?:at|AT|@)[\])] ?| (?:at|AT) "), re.compile(r" ?[\[(](?:dot|DOT|\.)[\])] ?| (?:dot|DOT) ")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*")
#: Characters of the longest span that any kind allows: an address of 254 with every dot spelled out.
LONGEST = 640


def plain(found: str) -> str:
    """A span as it is meant: name (at) host [dot] org is name@host.org, 10.0.0[.]1 is 10.0.0.1."""
    return _DOT.sub(".", _AT.sub("@", found))


def plausible(kind: str, found: str) -> bool:
    """What a tagged span must be beside the tagger's word for it: its kind in a plain, separated or spelled-out form."""
    if len(found) > LONGEST:
        return False
    if kind == "email":
        return bool(ADDRESS.fullmatch(plain(found)))
    if kind == "ip":
        return bool(IP.fullmatch(plain(found))) and valid("ip", plain(found))
    if kind == "phone" and (re.search(r"[^0-9 ()./+-]", found) or not re.search(r"[ ()./-]", found.strip())):
        return False
    return found[0] in "+(0123456789" and found[-1] in "0123456789" and valid(kind, found)


def stream_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts with blank stretches between, windows' starts in them, each window's text, its place there)."""
    table = symbol_table().astype(np.int8)
    n = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(n + SEARCH_WIDTH)]) + MARGIN
    out = np.zeros(int(at[-1]) + SEARCH_WIDTH, np.int8)
    for k, text in enumerate(texts):
        out[at[k] : at[k] + n[k]] = symbols(text, table)
    windows = -(-n // STRIDE)
    owner = np.repeat(np.arange(len(texts)), windows)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    return out, at[owner] + place - MARGIN, owner, place


def tagged(texts: Sequence[str], model: Tagger, least: float, chunk: int = 512) -> list[list[tuple[float, Span]]]:
    """Spans of each text with their scores, the least marginal of their tags.

    Windows overlap and cover every text from end to end; all are decoded. Each
    character takes its tag from the window in whose middle it lies, so a span
    may be of any length and lie anywhere: it goes on into the next window's
    middle while that has the same kind there. A chunk of windows is small
    enough that its matrix products run on one thread: a second one would only
    wait, and count as time.
    """
    stream, start, owner, place = stream_of(texts)
    found, held, which = [], [], []

    def decode() -> None:
        if not held:
            return
        tags, sure = model.decode(np.concatenate(held, 1))
        some = np.concatenate(which)
        held.clear()
        which.clear()
        tags, sure = tags[MARGIN : MARGIN + STRIDE].T, sure[MARGIN : MARGIN + STRIDE].T
        w, t = np.nonzero(tags)
        found.append((owner[some[w]], place[some[w]] + t, t == 0, tags[w, t], sure[w, t]))

    for lo in range(0, len(start), chunk):
        e = model.emissions(stream[start[lo : lo + chunk, None] + np.arange(SEARCH_WIDTH)])
        some = np.flatnonzero(~model.all_plain(e))
        held.append(e[:, some])
        which.append(lo + some)
        if sum(map(len, which)) >= chunk:
            decode()
    decode()
    out: list[list[tuple[float, Span]]] = [[] for _ in texts]
    if not found:
        return out
    doc, pos, opens, tag, sure = (np.concatenate(v) for v in zip(*found, strict=True))
    inside = pos < np.array([len(t) for t in texts])[doc]
    doc, pos, opens, tag, sure = (v[inside] for v in (doc, pos, opens, tag, sure))
    if not len(doc):
        return out
    kind = (tag - 1) // 2
    goes_on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (kind[1:] == kind[:-1]) & ((tag[1:] % 2 == 0) | opens[1:])
    first = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(first[1:], len(doc)) - 1
    score = np.minimum.reduceat(sure, first)
    for a, b, s in zip(first, last, score, strict=True):
        if s >= least:
            out[doc[a]].append((float(s), (KINDS[kind[a]], int(pos[a]), int(pos[b]) + 1)))
    return out


def all_spans(texts: Sequence[str], model: Tagger, least: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text.

    Base spans stay. Tagged spans of all windows are reconciled over the whole
    text: surest first, the longer of equals, each unless it overlaps one that
    is kept. Characters in use are marked, so time grows with the spans' length.
    """
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, more in zip(texts, base, tagged(texts, model, least), strict=True):
        kept = list(own)
        if more:
            used = np.zeros(len(text), bool)
            for _, a, b in own:
                used[a:b] = True
            for _, (kind, a, b) in sorted(set(more), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
                if not used[a:b].any() and plausible(kind, text[a:b]):
                    used[a:b] = True
                    kept.append((kind, a, b))
        out.append((own, in_order(kept)))
    return out


FOUND = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, redacted string"


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with a placeholder for each stretch of spans."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: Tagger, keep: Sequence[str] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The columns of `keep` with FOUND: pattern spans, all spans (code points, end exclusive), and the text with placeholders.

    A null text is empty and stays null in `redacted`. Rows with one id are
    searched each; columns that aren't in `keep` are not read.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in keep if c not in ("base", "spans", "redacted")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = lambda spans: [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").to_pylist()
            texts = [t or "" for t in raw]
            found = all_spans(texts, model, least)
            hidden = [None if t is None else redact(t, s) if s else t for t, (_, s) in zip(raw, found, strict=True)]
            columns = [pa.array(rows([b for b, _ in found]), kind), pa.array(rows([s for _, s in found]), kind), pa.array(hidden, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=[*kept, "base", "spans", "redacted"])

    asked = docs.select(*kept, *({"text"} - {*kept}))
    return asked.mapInArrow(run, T.StructType([asked.schema[c] for c in kept] + T.StructType.fromDDL(FOUND).fields))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    form = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    n, added = F.size("spans").cast("bigint").alias("n_spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(form("base"), 256).alias("base_sha256"), form("spans").alias("spans"), n, added)
