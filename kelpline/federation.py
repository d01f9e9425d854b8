"""Searches over several named stores, a line ``name root embedder`` for each in a stores file, and bounded admission."""

from __future__ import annotations

import errno
import ipaddress
import socket
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any, TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.engine import Engine
from kelpline.operators.containers import interleave
from kelpline.operators.contextual import hashed_vectors

T = TypeVar("T")


@dataclass(frozen=True)
class Named:
    """``embedder``: ``none``, or ``hashed:N`` for hashed words in N numbers."""

    name: str
    root: str
    embedder: str = "none"

    def open(self, spark: SparkSession) -> Engine:
        kind, _, dims = self.embedder.partition(":")
        if kind == "none":
            return Engine(spark, self.root)
        if kind != "hashed" or not dims.isdigit():
            raise ValueError(f"store {self.name}: unknown embedder {self.embedder!r}")
        return Engine(spark, self.root, hashed_vectors(int(dims)), int(dims))


def read_stores(text: str, where: str = "stores") -> list[Named]:
    """Stores of a file's text; blank lines and those that begin with # are passed over, others need three fields."""
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        fields = line.split()
        if not fields or fields[0].startswith("#"):
            continue
        if len(fields) != 3:
            raise ValueError(f'{where}:{i}: want "name root embedder"')
        out.append(Named(*fields))
    return out


def store_lines(pairs: list[str], embedder: str = "none") -> str:
    """A stores file's text from ``NAME=ROOT`` pairs."""
    if not pairs:
        raise ValueError("no stores given: want NAME=ROOT")
    lines: dict[str, str] = {}
    for p in pairs:
        name, sign, root = p.partition("=")
        if not (name and sign and root) or any(c in p for c in " \t#"):
            raise ValueError(f"bad store {p!r}: want NAME=ROOT")
        if name in lines:
            raise ValueError(f"store {name!r} given twice")
        lines[name] = f"{name} {root} {embedder}\n"
    return "".join(lines.values())


def pick(stores: list[Named], name: str = "") -> list[Named]:
    """The named store, or all of them without a name."""
    found = [s for s in stores if s.name == name] if name else stores
    if name and not found:
        raise LookupError(f"unknown store {name!r} (configured: {', '.join(s.name for s in stores)})")
    return found


class Federation:
    """Calls to several stores at once; one that fails is reported and the others answer, and only if all fail is it an error."""

    def __init__(self, spark: SparkSession, stores: list[Named], admission: Admission | None = None):
        """With ``admission``, searches and walks wait for one of its slots."""
        self.spark, self.stores, self.admission = spark, stores, admission

    def _each(self, call: Callable[[Engine], T]) -> tuple[list[tuple[int, T]], dict[str, str]]:
        def one(s: Named) -> Any:
            try:
                return True, call(s.open(self.spark))
            except Exception as e:  # a store's failure, whatever it is, must not take the others with it
                return False, e

        with ThreadPoolExecutor(max(1, min(8, len(self.stores)))) as pool:
            results = list(pool.map(one, self.stores))
        errors = {s.name: str(r) for s, (ok, r) in zip(self.stores, results) if not ok}
        if len(errors) == len(self.stores):
            raise RuntimeError(f"every store failed: {errors}")
        return [(i, r) for i, (ok, r) in enumerate(results) if ok], errors

    def _label(self, part: DataFrame, i: int) -> DataFrame:
        return part.withColumns({"store": F.lit(self.stores[i].name), "_store": F.lit(i)})

    def _bounded(self, call: Callable[[Engine], DataFrame]) -> tuple[list[DataFrame], dict[str, str]]:
        """Results of at most ``limit`` rows a store, run at once, so that what fails while it runs is reported too."""

        def run(e: Engine) -> tuple[list, Any]:
            df = call(e)
            return df.collect(), df.schema  # a page of hits

        found, errors = self.admission.run(lambda: self._each(run)) if self.admission else self._each(run)
        return [self._label(self.spark.createDataFrame(rows, schema), i) for i, (rows, schema) in found], errors

    def search(self, text: str = "", limit: int = 8, **more: Any) -> tuple[DataFrame, dict[str, str]]:
        """Hits taken in turn by rank, since scores of different stores don't compare; and the stores' errors."""
        parts, errors = self._bounded(lambda e: e.search(text, limit=limit, **more))
        names = [p.first().store if not p.isEmpty() else "" for p in parts]
        return interleave([p.drop("store", "_store") for p in parts], ["rank"], limit, names), errors

    def walk(self, container_id: str, **more: Any) -> tuple[DataFrame, dict[str, str]]:
        """Each store's page, one after the other."""
        parts, errors = self._bounded(lambda e: e.walk(container_id, **more))
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return both.orderBy("_store", "timestamp", "id").drop("_store"), errors

    def sessions(self, since: int, until: int = 0, **filters: str) -> tuple[DataFrame, dict[str, str]]:
        """All stores' sessions. They have no bound, so they stay a plan: only failures in planning are reported by store."""
        found, errors = self._each(lambda e: e.sessions(since, until, **filters))
        parts = [self._label(df, i) for i, df in found]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("_store", "first_ts", "container_id").drop("_store"), errors


class Admission:
    """At most ``slots`` searches at a time; ``deadline`` seconds cover waiting and running. Without slots all run at once."""

    def __init__(self, spark: SparkSession, slots: int = 2, deadline: float = 30.0):
        self.spark, self.deadline = spark, deadline
        self._free = threading.BoundedSemaphore(slots) if slots > 0 else None

    def run(self, search: Callable[[], T]) -> T:
        """What ``search`` returns or raises. Past the deadline its jobs are cancelled and TimeoutError is raised; the slot is held until it has ended."""
        if self._free is None:
            return search()
        until = time.monotonic() + self.deadline
        if not self._free.acquire(timeout=self.deadline):
            raise TimeoutError("no search slot was free in time")
        tag, result, free = f"search-{uuid.uuid4().hex}", {}, self._free

        def work() -> None:
            try:
                self.spark.addTag(tag)
                result["value"] = search()
            except BaseException as e:
                result["error"] = e
            finally:
                free.release()

        thread = InheritableThread(target=work, session=self.spark, daemon=True)
        thread.start()
        thread.join(max(0.0, until - time.monotonic()))
        if thread.is_alive():
            self.spark.interruptTag(tag)
            raise TimeoutError(f"the search took longer than {self.deadline} s")
        if "error" in result:
            raise result["error"]
        return result["value"]


def from_this_host(address: str) -> bool:
    """Whether a caller's ``host:port`` is this machine's, so that a service in front of the engine can refuse its records. What can't be read or tried counts as its own."""
    host, colon, port = address.rpartition(":")
    try:
        ip = ipaddress.ip_address(host[1:-1] if host.startswith("[") and host.endswith("]") else host)
    except ValueError:
        return True
    if not colon or not port.isdigit() or ip.is_loopback:
        return True
    try:
        with socket.socket(socket.AF_INET6 if ip.version == 6 else socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.bind((str(ip), 0))  # only an own address can be bound
        return True
    except OSError as e:
        return e.errno != errno.EADDRNOTAVAIL
