"""Named panels: what each is made of, written once, and kept as long as a result reads it.

A catalog holds nodes: sources, panels made of other panels, and factors by name, one's own among them. ``Panels``
makes them for one folder of tables. A result is planned under a lease, which counts the written panels it is made of;
a panel is deleted when the last lease on it is released, never because something else is planned.
"""

from __future__ import annotations

import atexit
import threading
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors
from ..sources.scratch import Scratch
from ..sources.starschema import Star


@dataclass(frozen=True)
class Node:
    """A panel: ``make`` takes the panels it ``needs`` (a source takes the folder's tables); ``stored`` ones are written.

    A ``folder`` is made by ``make(spark, path, panels)``, which writes what it likes below the path.
    """

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    stored: bool = False
    source: bool = False
    folder: bool = False


class Factor(ABC):
    """A factor of one's own. ``needs`` names the panels that ``compute`` takes."""

    name: str
    needs: tuple[str, ...] = ("months",)

    @abstractmethod
    def compute(self, *panels: DataFrame) -> DataFrame:
        """``date, ticker, raw_score`` at month-ends; null or absent where it can't be told."""


class Catalog:
    """Nodes by name, and for each factor the node that has its column."""

    def __init__(self, base: Catalog | None = None):
        self.nodes: dict[str, Node] = dict(base.nodes) if base else {}
        self.families: dict[str, str] = dict(base.families) if base else {}

    def add(self, node: Node) -> None:
        """A node under a new name; it can only need what is there, so there are no cycles."""
        if node.name in self.nodes:
            raise ValueError(f"there is a panel {node.name} already")
        for need in node.needs:
            self.node(need)
        self.nodes[node.name] = node

    def node(self, name: str) -> Node:
        if name not in self.nodes:
            raise ValueError(f"no panel {name}")
        return self.nodes[name]

    def source(self, name: str, make: Callable[[Star], DataFrame], stored: bool = False) -> None:
        self.add(Node(name, (), make, stored, source=True))

    def panel(self, name: str, needs: list[str], make: Callable[..., DataFrame], stored: bool = False) -> None:
        self.add(Node(name, tuple(needs), make, stored))

    def folder(self, name: str, needs: list[str], make: Callable[..., None]) -> None:
        self.add(Node(name, tuple(needs), make, stored=True, folder=True))

    def family(self, name: str, needs: list[str], make: Callable[..., DataFrame], names: list[str]) -> None:
        """A panel with a column for each of the factors ``names``."""
        self.panel(name, needs, make)
        self.families.update({n: name for n in names})

    def factor(self, own: Factor) -> None:
        """A factor of one's own, from then on used like those that come with the library."""
        if own.name in self.families:
            raise ValueError(f"there is a factor {own.name} already")
        make = lambda *panels: own.compute(*panels).select("date", "ticker", F.col("raw_score").alias(own.name))
        self.family(f"factor {own.name}", list(own.needs), make, [own.name])

    def scores(self, names: list[str]) -> str:
        """The name of the written panel with all stages of the scores of ``names``; made known on first use."""
        names = sorted(names)
        key = "scores " + ",".join(names)
        if key not in self.nodes:
            unknown = [n for n in names if n not in self.families]
            if unknown:
                raise ValueError(f"no factor {unknown[0]}")
            groups = list(dict.fromkeys(self.families[n] for n in names))

            def make(*panels: DataFrame) -> DataFrame:
                *rows, months, metadata = panels
                return factors.factor_scores(factors.raw_scores(rows, names), months, metadata)

            self.panel(key, [*groups, "months", "metadata"], make, stored=True)
        return key


class Panels:
    """The panels of one folder, made when they are first asked for."""

    def __init__(self, catalog: Catalog, star: Star):
        self.catalog, self.star = catalog, star
        self.tables: dict[str, DataFrame | str] = {}
        self.readers: Counter = Counter()
        self.lock, self.scratch = threading.RLock(), Scratch(star.spark)

    def lease(self) -> Lease:
        return Lease(self)

    def _get(self, name: str, held: set[str]) -> DataFrame | str:
        node = self.catalog.node(name)
        if node.stored and name in self.tables:
            self._hold(name, held)
            return self.tables[name]
        needs = [self._get(n, held) for n in node.needs]
        if node.folder:
            path = self.scratch.folder(name.split(" ")[0])
            node.make(self.star.spark, path, *needs)
            self.tables[name] = path
        else:
            rows = node.make(self.star) if node.source else node.make(*needs)
            if not node.stored:
                return rows
            self.tables[name] = self.scratch.write(rows, name.split(" ")[0])
        self._hold(name, held)
        return self.tables[name]

    def _hold(self, name: str, held: set[str]) -> None:
        if name not in held:
            held.add(name)
            self.readers[name] += 1

    def _let_go(self, held: set[str]) -> None:
        self.readers.subtract(held)
        gone = [n for n in held if self.readers[n] <= 0]
        for name in gone:
            del self.tables[name], self.readers[name]
        held.clear()
        if gone:
            self.scratch.drop(*self.tables.values())


class Lease:
    """What one result reads: call it with a panel's name (a folder's gives its path); ``release`` ends it."""

    def __init__(self, panels: Panels):
        self.panels, self.held, self.seen = panels, set(), {}

    def __call__(self, name: str) -> DataFrame | str:
        with self.panels.lock:
            if name not in self.seen:
                self.seen[name] = self.panels._get(name, self.held)
            return self.seen[name]

    def scores(self, names: list[str]) -> DataFrame:
        return self(self.panels.catalog.scores(names))

    def family(self, name: str) -> DataFrame:
        """The panel with the column of factor ``name``."""
        return self(self.panels.catalog.families[name])

    def table(self, name: str) -> DataFrame:
        return self.panels.star.table(name)

    def release(self) -> None:
        with self.panels.lock:
            self.seen.clear()
            self.panels._let_go(self.held)

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *problem) -> None:
        self.release()


#: Panels of this process by (application, folder, its files' lengths and times, kind of ticker), and leases of results.
_open: dict[tuple, Panels] = {}
_leases: dict[int, tuple[DataFrame, Lease]] = {}
_lock = threading.RLock()


def opened(spark: SparkSession, catalog: Catalog, path: str, by: str) -> Panels:
    """The panels that all results over ``path`` share in this application, as long as its files stay the same."""
    star = Star(spark, path, by)
    key = (spark.sparkContext.applicationId, id(catalog), path, star.stamp(), by)
    with _lock:
        return _open.setdefault(key, Panels(catalog, star))


def leased(result: DataFrame, lease: Lease) -> DataFrame:
    """``result``, with its lease to be ended by :func:`release`, or when the process ends."""
    with _lock:
        _leases[id(result)] = (result, lease)
    return result


def release(*results: DataFrame) -> None:
    """Ends the leases of ``results`` (of all, if none is given); what no other result reads is deleted."""
    with _lock:
        ended = [_leases.pop(id(r)) for r in results if id(r) in _leases] if results else [_leases.pop(k) for k in list(_leases)]
    for _, lease in ended:
        lease.release()


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except (Py4JError, Py4JNetworkError, AttributeError):  # the session has ended before: its folder is no longer reached
        pass
