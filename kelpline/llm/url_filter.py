"""URL filters: allow and block rules for hosts and path prefixes, probed in a sorted digest array.

Method: the rules' 64-bit xxhash keys lie sorted in a file that executors memory-map; a batch of URLs is turned
into its candidate keys (each suffix of the host at a label's edge, with each path prefix of a length
that a rule has), all probed by one vectorised binary search; every hit is confirmed on the stored full strings.
The files go to the executors with ``SparkContext.addFile``; they are mapped, not loaded, so pages in use, not the
list's size, take memory. They are named by what they hold: a session ships a list once, however often it is used, and the folder that the driver
serves them from is deleted when it ends. The rules are a parameter and are sorted on the driver, which holds them anyway.

Verdict: the longest fitting rule's. Where none fits, the method's own: block if a label of the host is one of
the names in the block list (kept in the same digest array), else allow.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is allowed. Of rules
equally long the one with the longer host wins, then block over allow. Rules may repeat; two verdicts for
one host and path raise an error. Other columns stay.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import fresh

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Names that are blocked as a label of a host where no rule fits.
BLOCKED_NAMES = ("spam-farm", "cheap-pills", "click-bait", "free-money")


class DigestArray:
    """Strings with a one-byte value: sorted keys, and the full strings behind an offset array. All parts are memory-mapped."""

    PARTS = ("keys", "values", "offsets", "bytes")

    def __init__(self, path: str):
        self.keys, self.values, self.offsets, self.bytes = (np.load(f"{path}.{p}.npy", mmap_mode="r") for p in self.PARTS)

    @classmethod
    def write(cls, path: str, entries: Iterable[tuple[str, int]]) -> list[str]:
        rows = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in entries)
        texts = [s.encode() for _, s, _ in rows]
        parts = {
            "keys": np.array([k for k, _, _ in rows], np.uint64),
            "values": np.array([v for _, _, v in rows], np.uint8),
            "offsets": np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64),
            "bytes": np.frombuffer(b"".join(texts) or b"\0", np.uint8),
        }
        for name, a in parts.items():
            np.save(f"{path}.{name}.npy", a)
        return [f"{path}.{p}.npy" for p in cls.PARTS]

    def find(self, texts: list[str]) -> np.ndarray:
        """Value of each text, -1 where it isn't held."""
        out = np.full(len(texts), -1, np.int16)
        if not len(self.keys) or not texts:
            return out
        want = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, want)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want)
        for i in hit:
            j = at[i]
            while j < len(self.keys) and self.keys[j] == want[i]:  # colliding strings lie side by side
                if self.bytes[self.offsets[j] : self.offsets[j + 1]].tobytes() == texts[i].encode():
                    out[i] = self.values[j]
                    break
                j += 1
        return out


def _key(host: str, path: str) -> str:
    """The host's length in front tells host and path apart, whatever they hold; a name is a path without a host."""
    return f"{len(host)}:{host}{path}"


def _ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]], names: Iterable[str]) -> tuple[str, list[int]]:
    table: dict[str, int] = {}
    lengths: set[int] = set()
    for verdict, host, path in rules:
        k, v = _key(host, path), int(verdict == "block")
        if table.setdefault(k, v) != v:
            raise ValueError(f"conflicting rules for {host}{path}")
        lengths.add(len(path))
    table |= {_key("", n): 2 for n in names}
    content = repr(sorted(table.items())).encode("utf-8", "surrogatepass")
    name = f"url-rules-{hashlib.sha256(content).hexdigest()[:24]}"
    known = {f.rsplit("/", 1)[1] for f in spark.sparkContext.listFiles}
    if f"{name}.{DigestArray.PARTS[-1]}.npy" not in known:
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for f in DigestArray.write(os.path.join(folder, name), table.items()):
            spark.sparkContext.addFile(f)
    return name, sorted(lengths)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the rules see them."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    ends = [j for c in "?#" if (j := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {i: i + 32 for i in range(65, 91)}


def _judge(urls: list[str | None], table: DigestArray, lengths: list[int]) -> dict[str, list]:
    """host, path, rule and verdict of each url; all candidates of a batch are probed at once."""
    hosts, paths = map(list, zip(*map(split_url, urls))) if urls else ([], [])
    owner: list[int] = []
    tried: list[tuple[str, str]] = []
    suffixes: dict[str, list[str]] = {}
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if not host:
            continue
        if host not in suffixes:
            labels = host.split(".")
            suffixes[host] = [".".join(labels[j:]) for j in range(len(labels))]
        for n in lengths:
            if n <= len(path):
                tried += [(h, path[:n]) for h in suffixes[host]]
                owner += [i] * len(suffixes[host])
    values = table.find([_key(h, p) for h, p in tried])
    best: list[tuple] = [()] * len(urls)
    for j in np.flatnonzero(values >= 0):
        host, path = tried[j]
        if not host:
            continue
        best[owner[j]] = max(best[owner[j]], (len(host) + len(path), len(host), int(values[j]), host + path))
    distinct = list({lab for h in suffixes for lab in h.split(".")})
    bad = {lab for lab, v in zip(distinct, table.find([_key("", lab) for lab in distinct])) if v == 2}
    verdicts = [("block" if b[2] else "allow") if b else "block" if bad and not bad.isdisjoint(h.split(".")) else "allow" for b, h in zip(best, hosts)]
    return {"host": hosts, "path": paths, "rule": [b[3] if b else None for b in best], "verdict": verdicts}


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, names: Iterable[str] = BLOCKED_NAMES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict; these replace same-named columns."""
    name, lengths = _ship(pages.sparkSession, rules, names)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = DigestArray(SparkFiles.get(name))
        for urls in batches:
            yield pd.DataFrame(_judge([None if pd.isna(u) else u for u in urls], table, lengths))

    # files are sent one by one; the common stem is what DigestArray opens
    v = F.pandas_udf(judge, "host string, path string, rule string, verdict string")(F.col(url))
    (c,) = fresh(pages, "judged")
    out = pages.withColumn(c, v)
    return out.withColumns({k: F.col(c)[k] for k in ("host", "path", "rule", "verdict")}).drop(c)

