"""Addresses: ``st.{Model+}.doc.field``, ``se.a.b``, ``gse.a.b`` and ``gse.a.b.se.{store}``."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import CatalogError

ROOTS = ("st", "se", "gse")


@dataclass(frozen=True)
class Address:
    """``root`` st, se, gse or bridge; the rest as far as it is given."""

    root: str
    model: str | None = None
    descendants: bool = False
    doc: str | None = None
    field: str | None = None
    tag: str | None = None
    store: str | None = None


class _Walk:
    """Goes over an address from left to right; what doesn't fit is an error."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def wrong(self) -> CatalogError:
        return CatalogError(f"no such address: {self.text}")

    @property
    def ended(self) -> bool:
        return self.at == len(self.text)

    def upto(self, stops: str) -> str:
        """The characters before the next of ``stops`` or the end; none is an error."""
        begin = self.at
        while not self.ended and self.text[self.at] not in stops:
            self.at += 1
        if begin == self.at:
            raise self.wrong()
        return self.text[begin : self.at]

    def skip(self, mark: str) -> None:
        if not self.text.startswith(mark, self.at):
            raise self.wrong()
        self.at += len(mark)

    def scope(self) -> Address:
        self.skip("{")
        model = self.upto("{}+")
        descendants = self.text.startswith("+", self.at)
        self.skip("+}" if descendants else "}")
        rest: list[str] = []
        if not self.ended:
            self.skip(".")
            rest.append(self.upto("."))
        if not self.ended:
            self.skip(".")
            rest.append(self.upto(""))
        return Address("st", model, descendants, *rest)

    def global_tag(self) -> Address:
        tag = self.upto("")
        known, mark, store = tag.rpartition(".se.{")
        if not mark or not known or not store.endswith("}") or not store[:-1] or set(store[:-1]) & set("{}"):
            return Address("gse", tag=tag)
        return Address("bridge", tag=known, store=store[:-1])


def parse_address(text: str) -> Address:
    walk = _Walk(text)
    root = walk.upto(".")
    if root not in ROOTS:
        raise walk.wrong()
    if walk.ended:
        return Address(root)
    walk.skip(".")
    if root == "st":
        return walk.scope()
    return walk.global_tag() if root == "gse" else Address("se", tag=walk.upto(""))
