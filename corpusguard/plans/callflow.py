"""Files to call-flow graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from corpusguard.operators import graph as G, resolve as R, structure as S
from corpusguard.session import materialized


@dataclass(frozen=True)
class CallFlow:
    """The graph over ``files``, planned on first use.

    ``events`` are the written structure lines; the links, which nodes and edges
    both read, are written once as well.
    """

    files: DataFrame
    known: DataFrame
    events: DataFrame

    @cached_property
    def functions(self) -> DataFrame:
        return S.functions(self.events, "detail")

    @cached_property
    def imports(self) -> DataFrame:
        return R.resolve_imports(S.all_imports(self.events), self.known)

    @cached_property
    def calls(self) -> DataFrame:
        bindings = R.resolve_bindings(self.imports, self.functions, S.exports(self.events, "detail"))
        return R.resolve_calls(S.call_edges(self.events, "detail"), self.functions, bindings)

    @cached_property
    def file_calls(self) -> DataFrame:
        return R.resolve_file_calls(S.file_calls(self.events), self.known)

    @cached_property
    def links(self) -> DataFrame:
        http = G.file_links(self.file_calls, self.functions, self.files)
        return materialized(G.call_links(self.calls, self.functions).unionByName(http), "links")

    @cached_property
    def nodes(self) -> DataFrame:
        return G.nodes(self.functions, self.links)

    @cached_property
    def edges(self) -> DataFrame:
        return G.edges(self.links)


def build_call_flow(files: DataFrame, known: DataFrame, events: DataFrame | None = None) -> CallFlow:
    """``files`` are analyzed files, ``known`` the (repo, file) paths that exist."""
    return CallFlow(files, known, materialized(S.events(files), "events") if events is None else events)
