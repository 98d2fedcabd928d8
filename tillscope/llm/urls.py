"""URL filters: a bit-parallel automaton that runs all wildcard rules over a URL at once.

A rule is a glob: ``*`` stands for any bytes but a slash, ``**`` for any bytes, and a backslash
takes the wildcard's meaning from the byte behind it. Globs meet a URL's canonical form (see
:func:`canonical`), so that escapes, ports or dot segments do not hide it. Every state of
every rule is one bit; the bits of all rules are packed into 64-bit words. For each byte of a
URL the states move by one shift-and: a state goes on if its next byte matches, and stays if a
wildcard behind it takes the byte. Rules do not get slower one by one: 64 states cost a word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLASH = ord("/")


class Globs:
    """Masks of a list of globs, and their simulation over many strings at once."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        literal, loops, start, final = [], [], [], []  # per bit
        for pattern in patterns:
            start.append(len(literal))
            literal.append(None)
            loops.append("")
            raw = pattern.encode()
            i = 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    wide = raw[i:i + 2] == b"**"
                    loops[-1] = "any" if wide or loops[-1] == "any" else "host"
                    i += 2 if wide else 1
                else:
                    i += raw[i] == ord("\\") and i + 1 < len(raw)
                    literal.append(raw[i])
                    loops.append("")
                    i += 1
            final.append(len(literal) - 1)
        words = (len(literal) + 63) // 64
        self.next = np.zeros((256, words), np.uint64)   # states entered by a byte
        self.stay = np.zeros((256, words), np.uint64)   # states kept by a byte
        self.start = self._mask(start, words)
        self.final = [(f // 64, np.uint64(1 << (f % 64))) for f in final]
        for bit, (byte, loop) in enumerate(zip(literal, loops)):
            word, one = bit // 64, np.uint64(1 << (bit % 64))
            if byte is not None:
                self.next[byte, word] |= one
            if loop:
                self.stay[:, word] |= one
                if loop == "host":
                    self.stay[SLASH, word] &= ~one

    @staticmethod
    def _mask(bits, words):
        mask = np.zeros(words, np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1 << (b % 64))
        return mask

    def match(self, strings: list[bytes]) -> np.ndarray:
        """Rows by patterns: does the whole string match. Strings go on while they have bytes."""
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(strings), np.uint8)
        begin = (np.cumsum(length) - length)[order]
        state = np.repeat(self.start[None], len(strings), 0)
        sorted_length = length[order]
        for at in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-sorted_length, -at, side="left"))  # longer than ``at``
            byte = flat[begin[:n] + at]
            old = state[:n]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.next[byte]) | (old & self.stay[byte])
        out = np.empty((len(strings), len(self.patterns)), bool)
        for k, (word, one) in enumerate(self.final):
            out[order, k] = (state[:, word] & one) != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def globs_of_rule(host: str, path: str) -> list[str]:
    """A host rule as globs over host and path: the host itself and all its subdomains.

    The rule is taken literally; a star in it is a star.
    """
    plain = re.sub(r"([*\\])", r"\\\1", host + path)
    return [f"{plain}**", f"*.{plain}**"]


def canonical(host: str, path: str) -> str:
    """Host and path as one string in which different spellings of a URL are equal.

    The host loses user part, port and dots at its end. In the path escapes of printable ASCII
    are decoded once, repeated slashes become one, and the segments ``.`` and ``..`` are
    resolved. Letters of the path keep their case and other escapes stay.
    """
    host = re.sub(r"(:[0-9]*)?\Z", "", host.rpartition("@")[2], count=1).rstrip(".")
    path = re.sub(r"%([2-6][0-9A-Fa-f]|7[0-9A-Ea-e])", lambda m: chr(int(m[1], 16)), path)
    path = re.sub("/+", "/", path)
    if "/." in path:
        kept = [""]
        for segment in path.split("/")[1:]:
            if segment == "..":
                kept = kept[:max(len(kept) - 1, 1)]
            elif segment != ".":
                kept.append(segment)
        path = "/".join(kept) + "/" * bool(re.search(r"/\.\.?\Z", path))
    return host + path


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: list[str],
           url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: verdict, host, path; the longest that fits a URL decides. ``blocked``: globs over
    the canonical form that block where no rule fits; all else is allowed. Rules meet host and path
    as they stand. All run in one automaton, a second time only where the canonical form differs.
    Null URLs and those without ``://`` have an empty host and path, fit no rule, and are
    allowed unless a glob matches the empty string. Rows are judged one by one, so repeats and
    other columns do not matter; columns of those four names are replaced.
    """
    new = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in new]
    parts = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    owners = [k for k, (_, host, path) in enumerate(rules) for _ in globs_of_rule(host, path)]
    globs = [g for _, host, path in rules for g in globs_of_rule(host, path)]
    longest_first = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    names = [host + path for _, host, path in rules] + [None]
    verdicts = [v for v, _, _ in rules]

    def run(batches):
        automaton = Globs(globs + blocked)
        owner = np.array(owners, int)
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            pairs = list(zip(host.to_pylist(), path.to_pylist()))
            strings = [h + p for h, p in pairs]
            others = [canonical(h, p) for h, p in pairs]
            changed = [i for i, (s, o) in enumerate(zip(strings, others)) if s != o]
            every = automaton.match([s.encode() for s in strings + [others[i] for i in changed]])
            hits = every[:len(strings)]
            blocking = hits[:, len(globs):].any(1)
            blocking[changed] = every[len(strings):, len(globs):].any(1)
            fits = np.zeros((len(strings), len(rules)), bool)
            for g, k in enumerate(owner):
                fits[:, k] |= hits[:, g]
            chosen = np.full(len(strings), -1)
            for k in reversed(longest_first):
                chosen[fits[:, k]] = k
            rule = [names[k] for k in chosen]
            verdict = [verdicts[k] if k >= 0 else "block" if b else "allow"
                       for k, b in zip(chosen.tolist(), blocking.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns)]
                + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(run, schema + ", rule string, verdict string")
