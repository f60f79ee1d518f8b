"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained here in numpy, on labelled spans that a seeded generator
writes. It reads overlapping windows around every digit, `@` and written-out `(at)`; each
character's emissions come from the window in whose middle it lies, and one Viterbi path is
decoded over all windows that touch, so that spans of any length are found whole. A span
holds one of those signs and no line feed, so windows without one hold none:
the constraint makes skipping them exact.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillstream.llm.kernels import buffer_of, slices, tidy
from quillstream.llm.shared import project

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
HIDDEN = 16
#: Size of the training set and of training.
EXAMPLES, EPOCHS, BATCH, RATE = 2048, 12, 64, 0.025
#: Windows that are read together, and characters that are decoded together.
READ, DECODED = 1024, 1 << 17
#: Least log-odds of a span's labels against none, transitions included.
LEAST_MARGIN = 3.0
#: Fixed value: characters of an address, at most.
LONGEST_EMAIL = 320

# ---- fixed patterns -------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each `@`: the run of local characters before it, then the domain."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- network --------------------------------------------------------------------

#: Character classes: each of these signs is one, then lower, upper, digit, other letters, other blanks, the rest.
SIGNS = "@.-+() _%:/=\",\n<>#[]"
N_CLASSES = len(SIGNS) + 6
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(SIGNS)
    out = np.where(codes < 128, n + 5, n + 3).astype(np.int64)
    out[(codes >= 97) & (codes <= 122)] = n
    out[(codes >= 65) & (codes <= 90)] = n + 1
    out[(codes >= 48) & (codes <= 57)] = n + 2
    out[(codes == 9) | (codes == 13) | (codes == 0xA0)] = n + 4
    for k, c in enumerate(SIGNS):
        out[codes == ord(c)] = k
    return out


def allowed() -> np.ndarray:
    """Which tag may follow which: inside only after begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lsm(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Parameters by name, as float32 arrays: for each direction an input table, recurrent weights, then output and transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        p = {}
        for d in "lr":
            p[f"x{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * h))
            p[f"x{d}"][:, h : 2 * h] += 1  # remember at first
            p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        p["out"] = rng.normal(0, 0.3, (2 * h, TAGS))
        p["bias"] = np.zeros(TAGS)
        p["move"] = np.zeros((TAGS, TAGS))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def run(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (text, time, hidden) of one direction."""
        n, t_max = ids.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, t_max, HIDDEN), np.float32)
        x, u = self.p[f"x{d}"], self.p[f"u{d}"]
        for t in range(t_max) if d == "l" else range(t_max - 1, -1, -1):
            z = x[ids[:, t]] + h @ u
            gate, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            before, h_before = c, h
            c = f * c + i * new
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, h_before, before, i, f, o, new, tc))
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self.run(ids, d, None if keep is None else keep.setdefault(d, [])) for d in "lr"], axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    def moves(self) -> np.ndarray:
        return np.where(allowed(), self.p["move"], np.float32(-1e4))

    def loss_and_gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        e, a = self.emissions(ids, keep), self.moves()
        n, t_max, _ = e.shape
        first = np.where(allowed()[0], 0, -1e4).astype(np.float32)
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + first
        for t in range(1, t_max):
            forward[:, t] = e[:, t] + lsm(forward[:, t - 1, :, None] + a, 1)
        for t in range(t_max - 2, -1, -1):
            backward[:, t] = lsm(a + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = lsm(forward[:, -1], 1)
        de = np.exp(forward + backward - total[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + a + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        row, col = np.arange(n)[:, None], np.arange(t_max)[None, :]
        score = (e[row, col, gold].sum(axis=1) + a[gold[:, :-1], gold[:, 1:]].sum(axis=1)).astype(np.float64)
        de[row, col, gold] -= 1
        np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g = {"move": np.where(allowed(), pair, 0) / n, "bias": de.sum(axis=(0, 1)) / n}
        de /= n
        both = keep["both"]
        g["out"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        dboth = de @ self.p["out"].T
        for k, d in enumerate("lr"):
            g |= self._through_time(ids, d, dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN], keep[d])
        return float((total - score).mean()), g

    def _through_time(self, ids: np.ndarray, d: str, dh_all: np.ndarray, keep: list) -> dict[str, np.ndarray]:
        x, u = self.p[f"x{d}"], self.p[f"u{d}"]
        gx, gu = np.zeros_like(x), np.zeros_like(u)
        dh = np.zeros((len(ids), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t, h_before, before, i, f, o, new, tc in reversed(keep):
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
            np.add.at(gx, ids[:, t], dz)
            gu += h_before.T @ dz
            dh, dc = dz @ u.T, dc * f
        return {f"x{d}": gx, f"u{d}": gu}

    def fit(self, ids: np.ndarray, gold: np.ndarray, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, history = 0, []
        for epoch in range(EPOCHS):
            order, losses = rng.permutation(len(ids)), []
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                take = order[at : at + BATCH]
                loss, g = self.loss_and_gradient(ids[take], gold[take])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v / max(1.0, norm / 5)
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            history.append(float(np.mean(losses)))
        return history

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (text, time) of windows, and what each tag of that path scores more than the tag for none would."""
        return self.path(self.emissions(ids))

    def path(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As decode, from emissions (text, time, tag)."""
        a = self.moves()
        n, t_max, _ = e.shape
        back = np.empty((n, t_max, TAGS), np.int8)
        best = e[:, 0] + np.where(allowed()[0], 0, -1e4).astype(np.float32)
        for t in range(1, t_max):
            score = best[:, :, None] + a
            back[:, t] = score.argmax(axis=1)
            best = e[:, t] + score.max(axis=1)
        tags = np.empty((n, t_max), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(t_max - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        row, col = np.arange(n)[:, None], np.arange(t_max)[None, :]
        gain = e[row, col, tags].astype(np.float32) - e[:, :, 0]
        gain[:, 1:] += a[tags[:, :-1], tags[:, 1:]] - a[0, 0]
        return tags, gain


# ---- labelled spans -------------------------------------------------------------


def training_windows(n: int = EXAMPLES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Class ids and tags of windows of invented text with labelled spans and with look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda lo=2, hi=9: "".join(pick("etaoinshrdlucmfwypvbgkjqxz") for _ in range(int(rng.integers(lo, hi))))
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    octet = lambda: str(int(rng.integers(0, 256)))

    letter = lambda: pick("abcdefghijklmnopqrstuvwxyz" if rng.random() < 0.8 else "äöüéèçñøåæšžіжд漢字")
    name = lambda lo=2, hi=12: "".join(letter() for _ in range(int(rng.integers(lo, hi))))

    def email() -> str:
        part = pick([word, name])
        local = pick([".", ".", "-", "_", "+"]).join(part(2, 14) for _ in range(int(rng.integers(1, 5)))) + pick(["", "", number(2), "." + number(2)])
        host = pick([word() + number(1), word(), word() + "-" + word(), part(), ".".join(part(2, 14) for _ in range(int(rng.integers(2, 5))))])
        top = pick(["com", "org", "net", "de", "fr", "io", "info", "example.com", "co.uk", "example.org"])
        at, dot = pick([("@", "."), ("@", "."), ("@", "."), ("@", "."), ("(at)", "."), ("[at]", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return local + at + host + dot + top

    def ip() -> str:
        group = lambda: format(int(rng.integers(0, 65536)), "x")
        return pick([
            lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)), lambda: ":".join(group() for _ in range(8)),
            lambda: ":".join(group() for _ in range(int(rng.integers(2, 5)))) + "::" + group(), lambda: "fe80::" + ":".join(group() for _ in range(4)), lambda: "2001:db8::" + group(),
        ])()

    def card() -> str:
        body = number(int(rng.integers(14, 16)))
        digits = body + next(c for c in "0123456789" if luhn(body + c))
        sep = pick(["", "", " ", "-", ".", "/", " - "])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone() -> str:
        sep = pick([" ", "-", ".", "/"])
        return pick([
            lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"+{number(2)} {number(3)} {number(3)} {number(4)}", lambda: f"+{number(11)}",
            lambda: f"+{number(2)}-{number(3)}-{number(7)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}",
            lambda: f"{number(3)}{sep}{number(3)}{sep}{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"0{number(2)}{pick(' -/')}{number(7)}",
            lambda: f"0{number(3)}{sep}{number(3)}{sep}{number(4)}", lambda: f"00{number(2)} {number(3)} {number(7)}",
        ])()

    positive = [email, ip, card, phone]
    negative = [
        lambda: number(int(rng.integers(1, 8))), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}.{number(2)}.{number(4)}", lambda: f"{number(2)}/{number(2)}/{number(4)}",
        lambda: f"{number(1)}.{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: ":".join(number(1) + pick("abcdef") for _ in range(6)),
        lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        lambda: word() + "=" + "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(10, 20)))), lambda: '"' + "".join(pick("0123456789abcdef") for _ in range(36)) + '"',
        lambda: "@" + word(), lambda: word() + "@" + word(), lambda: f"{number(1)},{number(3)}", lambda: f"{number(4)}.{number(4)}", lambda: f"/{word()}/{number(5)}", lambda: f"{number(3)}-{number(2)}",
        lambda: f"{number(2)}-{number(5)}-{number(3)}", lambda: word() + "." + word() + "." + pick(["com", "org"]), lambda: f"({number(2)})", lambda: f"({word()})", lambda: f"[{number(2)}]", lambda: f"{number(3)},{number(3)},{number(3)}",
    ]
    ids, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, mark = "", []
        while len(text) < WINDOW + 100:
            roll = rng.random()
            if roll < 0.12:
                kind = int(rng.integers(len(KINDS)))
                piece = positive[kind]()
                mark += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            else:
                piece = pick(negative)() if roll < 0.28 else word(1, 12) if roll < 0.9 else name(1, 12)
                piece = piece.capitalize() if 0.8 < roll < 0.95 else piece
                mark += [0] * len(piece)
            sep = pick([" ", " ", " ", " ", ", ", ". ", "\n", ".\n", ": "])
            text, mark = text + piece + sep, mark + [0] * len(sep)
        # cut at a place where no span is open
        at = next(i for i in range(int(rng.integers(0, 40)), len(mark)) if i + WINDOW >= len(mark) or mark[i] % 2 or mark[i] == 0)
        at = min(at, len(mark) - WINDOW)
        while mark[at] and mark[at] % 2 == 0:
            at -= 1
        ids[k], tags[k] = classes_of(text[at : at + WINDOW]), mark[at : at + WINDOW]
    return ids, tags


@cache
def trained() -> Tagger:
    tagger = Tagger.fresh()
    tagger.fit(*training_windows())
    return tagger


# ---- windows and their reconciliation ---------------------------------------------

_AT = r"[(\[{] ?at ?[)\]}]"
_WORD = re.compile(r"(?<![^\s@])[^\s@]*+(?:@[^\s@]*+)+|[0-9]+")
_WRITTEN = re.compile(_AT, re.IGNORECASE)
_RIGHT = re.compile(r" ?[^\s([{]*")
_MARK = re.compile(rf"[0-9@]|{_AT}", re.IGNORECASE)
_EMAIL = re.compile(rf"(?:\S+@|\S+ ?{_AT} ?)\S+?(?:\.|[(\[{{] ?dot ?[)\]}}] ?)[^\s@]+", re.IGNORECASE)


def regions(text: str) -> list[tuple[int, int]]:
    """(first, last) numbers of windows that follow each other, window k starting at k * STRIDE: those around all
    digits, and around the whole words that an `@` or `(at)` stands in."""
    marks = [m.span() for m in _WORD.finditer(text)]
    floor = 0
    for m in _WRITTEN.finditer(text):
        before = text[floor : m.start()].rstrip(" ")
        start = floor + max(before.rfind(c) for c in " \t\n") + 1
        end = _RIGHT.match(text, m.end()).end()
        marks.append((start, end))
        floor = m.end()
    out: list[tuple[int, int]] = []
    for start, end in sorted(marks):
        first, last = max(0, start // STRIDE - 1), max(end - 1, 0) // STRIDE
        if last and last * STRIDE + STRIDE >= len(text):
            last -= 1  # the window before reaches the end
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, max(first, last)))
    return out


def plausible(kind: int, piece: str) -> bool:
    """What a span of its kind always has; the network's spans are checked against it."""
    digits = digits_of(piece)
    if kind == 0:
        return len(piece) <= LONGEST_EMAIL and _EMAIL.fullmatch(piece) is not None
    if kind == 1:
        try:
            ipaddress.ip_address(piece)
        except ValueError:
            return False
        return True
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 ./-]+", piece) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9 ()./-]+", piece) is not None and re.search(r"[ ()./+-]", piece) is not None


def tagged_spans(text: str, at: int, tags: np.ndarray, gain: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the spans of a path that begins at `at`."""
    edge = np.flatnonzero(tags[1:] != tags[:-1]) + 1
    begins = [t for t in [0, *edge.tolist()] if tags[t] % 2] if len(tags) else []
    # a begin right after another of its kind is an edge of its own
    begins = sorted({*begins, *np.flatnonzero(tags % 2).tolist()})
    for t in begins:
        tag, end = int(tags[t]), t + 1
        while end < len(tags) and tags[end] == tag + 1:
            end += 1
        if plausible(kind := (tag - 1) // 2, text[at + t : at + end]) and float(gain[t : end + 1].sum()) >= LEAST_MARGIN:  # with the step back to none
            yield at + t, kind, at + end


def network_spans(tagger: Tagger, texts: list[str], most: int = READ) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the network finds in each text.

    Held are the emissions of a region's characters, in half precision, and a batch of windows.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lines: list[tuple[int, int, np.ndarray]] = []  # text, place, emissions

    def flush() -> None:
        lines.sort(key=lambda x: len(x[2]))
        at = 0
        while at < len(lines):
            to = at + 1
            while to < len(lines) and (to - at + 1) * len(lines[to][2]) <= DECODED:
                to += 1
            e = np.full((to - at, len(lines[to - 1][2]), TAGS), -1e4, np.float32 if to > at + 1 else np.float16)
            e[:, :, 0] = 0
            for k, (_, _, x) in enumerate(lines[at:to]):
                e[k, : len(x)] = x
            tags, gain = tagger.path(e)
            for k, (i, place, x) in enumerate(lines[at:to]):
                found[i] += tagged_spans(texts[i], place, tags[k, : len(x)], gain[k, : len(x) + 1])
            at = to
        lines.clear()

    ids = np.full((most, WINDOW), N_CLASSES - 2, np.int64)
    jobs: list[tuple[int, int, int, int]] = []  # text, window, first and last of its region
    parts: list[np.ndarray] = []

    def read() -> None:
        """Emissions of the windows at hand; the middle of each goes to its region, and regions that end are cut into lines."""
        e = tagger.emissions(ids[: len(jobs)]).astype(np.float16)
        for row, (i, k, first, last) in enumerate(jobs):
            text = texts[i]
            lo = 0 if k == first else STRIDE // 2
            hi = min(WINDOW, len(text) - k * STRIDE) if k == last else STRIDE // 2 + STRIDE
            parts.append(e[row, lo:hi].copy())
            if k < last:
                continue
            whole = np.concatenate(parts)
            parts.clear()
            start, end = first * STRIDE, first * STRIDE + len(whole)
            for m in re.finditer(r"[^\n]+", text[start:end]):
                if _MARK.search(m.group()):
                    lines.append((i, start + m.start(), whole[m.start() : m.end()]))
        jobs.clear()
        if sum(len(x) for _, _, x in lines) > DECODED:
            flush()

    for i, text in enumerate(texts):
        for first, last in regions(text):
            for k in range(first, last + 1):
                c = classes_of(text[k * STRIDE : k * STRIDE + WINDOW])
                ids[len(jobs), : len(c)] = c
                ids[len(jobs), len(c) :] = N_CLASSES - 2
                jobs.append((i, k, first, last))
                if len(jobs) == most:
                    read()
    if jobs:
        read()
    flush()
    return [sorted(x) for x in found]


def all_spans(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and those added ones that overlap none of them."""
    out, i = list(base), 0
    ends = np.maximum.accumulate([e for _, _, e in base]) if base else []
    begins = [s for s, _, _ in base]
    for s, k, e in added:
        i = int(np.searchsorted(begins, e, "left"))
        if i == 0 or ends[i - 1] <= s:
            out.append((s, k, e))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_MARKED = np.zeros(256, bool)
_MARKED[48:58] = True
_MARKED[64] = True


def personal_data(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each document.

    The counts and base_sha256 are those of the fixed patterns, leftmost and
    non-overlapping for each kind, ips with parts of 255 at most, cards of 12 to 19
    digits that pass Luhn's check, phones of 9 to 15 digits. spans lists them and
    what the network adds where no base span lies, as kind:start:end by start and
    then kind, in code points, ends exclusive. A null text is an empty one and has no
    spans. Texts are read whole, in slices of bounded size. A null doc_id is kept,
    repeated rows are treated alike, an empty table gives no rows.
    """
    tagger = trained()
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                buf, offs = buffer_of(part)
                marked = np.flatnonzero(_MARKED[buf])
                n = len(part)
                written_out = pc.match_substring_regex(part, _AT, ignore_case=True).to_numpy(zero_copy_only=False)
                some = np.flatnonzero((np.diff(np.searchsorted(marked, offs)) > 0) | written_out)
                counts = np.zeros((len(KINDS), n), np.int64)
                sha, spans = [nothing] * n, [""] * n
                texts = part.take(pa.array(some)).to_pylist()
                for k, text, added in zip(some.tolist(), texts, network_spans(tagger, texts), strict=True):
                    base = base_spans(text)
                    for _, kind, _ in base:
                        counts[kind, k] += 1
                    sha[k] = hashlib.sha256(written(base).encode()).hexdigest()
                    spans[k] = written(all_spans(base, added))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), *map(pa.array, counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    rows = project(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
