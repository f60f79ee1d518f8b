"""URL filter: a bit-parallel automaton that runs all glob rules at once.

Every glob becomes a row of state bits in a multiword mask; one Shift-And step
for each byte of a canonical URL moves all patterns together. In a glob `?` is
one byte, `*` a run without `/`, `**` any run, and a backslash takes the next
sign as it is. A glob has to fit the whole canonical URL, which is host + path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.kernels import buffer_of, slices, tidy
from quillstream.llm.shared import project

#: Rules of the query: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: What the filter blocks where no rule fits; all else is allowed.
BLOCKED = ("*doubleclick.net/**", "**/wp-admin/**", "**/cgi-bin/**", "**.exe", "**.zip")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(host: str, path: str) -> tuple[str, str]:
    """A host and all its subdomains, with every path that starts with `path`."""
    return f"{escape(host)}{escape(path)}**", f"*.{escape(host)}{escape(path)}**"


@dataclass(frozen=True)
class GlobAutomaton:
    """Masks of a list of globs: step[c] and stay[c] for byte c, start, and final bits."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    final: np.ndarray

    @classmethod
    def build(cls, globs: Sequence[str]) -> GlobAutomaton:
        bits: list[tuple[int, set[int], set[int]]] = []  # state bit, bytes that enter it, bytes that stay
        starts, finals = [], []
        every, no_slash = set(range(256)), set(range(256)) - {ord("/")}
        for glob in globs:
            raw, i = glob.encode(), 0
            state: tuple[set[int], set[int]] = (set(), set())
            starts.append(len(bits))
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    state[1].update(every)
                    i += 2
                elif raw[i : i + 1] == b"*":
                    state[1].update(no_slash)
                    i += 1
                else:
                    bits.append((len(bits), *state))
                    if raw[i : i + 1] == b"?":
                        state = (set(every), set())
                    else:
                        i += raw[i : i + 1] == b"\\" and i + 1 < len(raw)
                        state = ({raw[i]}, set())
                    i += 1
            finals.append(len(bits))
            bits.append((len(bits), *state))
        width = max(1, (len(bits) + 63) // 64)
        step, stay = np.zeros((256, width), np.uint64), np.zeros((256, width), np.uint64)
        for bit, enter, hold in bits:
            mask = np.uint64(1 << bit % 64)
            for table, chars in ((step, enter), (stay, hold)):
                if chars:
                    table[sorted(chars), bit // 64] |= mask
        start = np.zeros(width, np.uint64)
        for bit in starts:
            start[bit // 64] |= np.uint64(1 << bit % 64)
        return cls(step, stay, start, np.array(finals, np.int64))

    def matches(self, texts: pa.Array) -> np.ndarray:
        """Boolean matrix: text by glob."""
        out = np.zeros((len(texts), len(self.final)), bool)
        for at, part in slices(texts, 1 << 20):
            buf, offs = buffer_of(part)
            size = np.diff(offs)
            order = np.argsort(-size, kind="stable")
            left, begin = size[order], offs[:-1][order]
            state = np.tile(self.start, (len(order), 1))
            for j in range(int(left[0]) if len(left) else 0):
                n = int(np.searchsorted(-left, -j, "left"))
                char, now = buf[begin[:n] + j], state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = moved & self.step[char] | now & self.stay[char]
            word, bit = self.final // 64, (self.final % 64).astype(np.uint64)
            out[at + order] = (state[:, word] >> bit & np.uint64(1)).astype(bool)
        return out


def split_url(url):
    """Host and path columns of a URL column."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked: Sequence[str] = BLOCKED,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of `pages`.

    A null url, an empty one, or one without `://` has empty host and path; no rule
    fits it, and it is allowed unless a blocked glob fits the empty text. Of rules
    that fit, the one with the longest text wins, then the one with the longer
    host, then block before allow. Repeated rows are judged alike, a null page_id
    is kept, an empty table gives no rows, other columns are not read. URLs of any
    length are read whole, in slices of bounded size.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    globs = [g for _, host, path in ranked for g in rule_globs(host, path)]
    automaton = GlobAutomaton.build([*globs, *blocked])
    names, verdicts = [h + p for _, h, p in ranked], [v for v, _, _ in ranked]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = automaton.matches(batch.column("canonical"))
            if not len(hit):
                continue
            by_rule = hit[:, : len(globs)].reshape(len(hit), len(names), 2).any(axis=2) if names else np.zeros((len(hit), 0), bool)
            found = by_rule.any(axis=1)
            first = np.where(found, by_rule.argmax(axis=1), -1) if names else np.full(len(hit), -1)
            bad = hit[:, len(globs) :].any(axis=1)
            rule = [names[i] if i >= 0 else None for i in first.tolist()]
            verdict = [verdicts[i] if i >= 0 else "block" if b else "allow" for i, b in zip(first.tolist(), bad.tolist(), strict=True)]
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    rows = project(pages, **{key: "bigint", url: "string"})
    host, path = split_url(F.col(url))
    rows = rows.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical", F.concat("host", "path"))
    return rows.mapInArrow(tidy(judge), "page_id bigint, host string, path string, rule string, verdict string")


def oracle_sql() -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in ranked]
    rule = " ".join(f"when {c} then '{name}'" for c, name, _ in fits)
    verdict = " ".join(f"when {c} then '{v}'" for c, _, v in fits)
    other = "regexp_full_match(host || path, '(?s)([^/]*doubleclick\\.net/.*|.*/wp-admin/.*|.*/cgi-bin/.*|.*\\.exe|.*\\.zip)')"
    return f"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when {other} then 'block' else 'allow' end as verdict
from parts"""
