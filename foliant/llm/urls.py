"""URL filtering with a bit-parallel wildcard automaton.

All glob patterns are packed into the bits of a few 64-bit words (multiword Shift-And). One step
per character advances every pattern at once, and a numpy batch advances many URLs at once, so the
work for a URL is its length times the number of words, whatever the number of patterns.

Canonical URL: host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased)
followed by the path (then up to ``?``, ``#`` or the end). Patterns match whole canonical URLs;
``*`` stands for any run without ``/`` and ``**`` for any run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

U = np.uint64
#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: What decides where no rule fits: any of these globs blocks, else the URL is allowed.
BLOCK_GLOBS = ("**/login", "**/login/**", "**/cart/**", "**/wp-admin/**", "**.exe", "**.zip", "*.invalid/**", "*.invalid")
_URL = re.compile(rb"://([^/?#]*)([^?#]*)")
_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Automaton:
    """Masks of a set of globs: ``step`` per byte, ``stay`` for the stars, ``first`` and ``last`` per pattern."""

    step: np.ndarray  # [256, words]: bits whose character is this byte
    stay: np.ndarray  # [256, words]: bits of states that a star keeps alive on this byte
    first: np.ndarray  # [words]
    ends: np.ndarray  # [patterns, 2]: word and bit of the accepting state

    @property
    def words(self) -> int:
        return self.step.shape[1]


def compile_globs(globs: Iterable[str]) -> Automaton:
    """Packs globs; a glob takes one bit more than it has literal bytes and never straddles into another's bits.

    State k of a pattern means: k literals matched. A star after literal k is a self-loop of state k.
    """
    plans: list[list[tuple[str, int]]] = []
    for glob in globs:
        plan, data, i = [], glob.encode(), 0
        while i < len(data):
            if data[i : i + 2] == b"**":
                plan.append(("any", 0))
                i += 2
            elif data[i : i + 1] == b"*":
                plan.append(("part", 0))
                i += 1
            else:
                plan.append(("lit", data[i]))
                i += 1
        plans.append(plan)
    total = sum(1 + sum(k == "lit" for k, _ in p) for p in plans)
    n = max(1, -(-total // 64))
    step, stay, first, ends, bit = np.zeros((256, n), U), np.zeros((256, n), U), np.zeros(n, U), [], 0
    for plan in plans:
        first[bit // 64] |= U(1) << U(bit % 64)
        for kind, byte in plan:
            if kind == "lit":
                bit += 1
                step[byte, bit // 64] |= U(1) << U(bit % 64)
            else:
                on = np.ones(256, bool)
                on[ord("/")] = kind == "any"
                stay[on, bit // 64] |= U(1) << U(bit % 64)
        ends.append((bit // 64, bit % 64))
        bit += 1
    return Automaton(step, stay, first, np.array(ends, np.int64).reshape(-1, 2))


def run(auto: Automaton, urls: list[bytes]) -> np.ndarray:
    """Boolean [urls, patterns]: which globs match the whole of which URL."""
    lengths = np.array([len(u) for u in urls], np.int64)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(urls), len(auto.ends)), bool)
    data = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths[order])[:-1]]) if len(urls) else lengths
    state = np.repeat(auto.first[None, :], len(urls), axis=0)
    live = len(urls)
    for at in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths[order][:live], -at, side="left"))  # those with a byte at this place
        byte = data[begins[:live] + at]
        now = state[:live]
        moved = now << U(1)
        moved[:, 1:] |= now[:, :-1] >> U(63)
        state[:live] = (moved & auto.step[byte]) | (now & auto.stay[byte])
    for k, (word, bit) in enumerate(auto.ends):
        out[order, k] = (state[:, word] >> U(bit)) & U(1) == 1
    return out


def canonical(url: str | None) -> tuple[bytes, bytes]:
    found = _URL.search(url.encode()) if url else None
    return (found[1].translate(_TO_LOWER), found[2]) if found else (b"", b"")


class Judge:
    """Rules with their verdicts over one automaton: the longest rule that fits decides, else the globs."""

    def __init__(self, rules=RULES, block_globs=BLOCK_GLOBS):
        # ties in length: block before allow, then by code point
        self.rules = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
        literal = [f"{host}{path}**" for host, path, _ in self.rules]
        self.automaton = compile_globs([*literal, *(f"*.{g}" for g in literal), *block_globs])

    def __call__(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        parts = [canonical(u) for u in urls]
        hit, n = run(self.automaton, [h + p for h, p in parts]), len(self.rules)
        fits = hit[:, :n] | hit[:, n : 2 * n]
        best = np.where(fits.any(1), fits.argmax(1) if n else 0, -1)
        blocked = hit[:, 2 * n :].any(1)
        found = []
        for (host, path), k, bad in zip(parts, best, blocked, strict=True):
            rule, verdict = (self.rules[k][0] + self.rules[k][1], self.rules[k][2]) if k >= 0 else (None, "block" if bad else "allow")
            found.append((host.decode(), path.decode(), rule, verdict))
        return found


def filter_urls(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row.

    A null url, or one without ``://``, has empty host and path and fits no rule. Repeated rows stay
    repeated; an empty table gives an empty one; other columns are not read. Rules are literal text
    without ``*``. A very long URL is judged whole (its batch of 4,096 takes as many steps as its longest has bytes); of rules that fit, the
    longest wins, so that none tie. One scan, no shuffle: URLs are the only column read besides the key.
    """
    kind = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Judge(rules, block_globs)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                host, path, rule, verdict = zip(*verdicts(part.column("url").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], [key, "host", "path", "rule", "verdict"])

    return pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url")).mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_GLOB_SQL = " OR ".join(f"regexp_full_match(url_key, '{re.escape(g).replace(re.escape('**'), chr(0)).replace(re.escape('*'), '[^/]*').replace(chr(0), '.*')}', 's')" for g in BLOCK_GLOBS)
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP9_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT page_id, host, path, host || path AS url_key,
       (SELECT arg_max(struct_pack(r := r.host || r.path, v := r.verdict), length(r.host || r.path)) FROM (VALUES {_RULE_ROWS}) r(host, path, verdict)
        WHERE (parts.host = r.host OR ends_with(parts.host, '.' || r.host)) AND starts_with(parts.path, r.path)) AS best FROM parts)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN {_GLOB_SQL} THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
