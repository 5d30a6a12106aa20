"""Typed blocks of a model's reply, read while it still comes in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from .split import BLANK


def header(line: str) -> tuple[str, dict[str, str] | None] | None:
    """``> type: k=v, k2=v2`` as (type, parameters or None); None for any other line."""
    line = line.strip(BLANK)
    rest = line[2:].strip(BLANK)
    if not line.startswith("> ") or not rest:
        return None
    kind, colon, pairs = rest.partition(": ")
    if not colon:
        return rest, None
    split = (p.partition("=") for p in pairs.split(", ") if "=" in p)
    return kind, {k.strip(BLANK): v.strip(BLANK) for k, _, v in split if k.strip(BLANK)} or None


@dataclass
class BlockParser:
    """Pieces of a text, cut anywhere -> its blocks, each as soon as it ends.

    A block ends at a line ``<``, at the next block's first line or at the text's end.  A text without a
    block is one of type ``text``; a blank one has none.  What is kept between pieces is the open line,
    the open block and, before the first block, the text so far.  The state can be saved as
    ``state()`` and set up again by ``BlockParser(**state)``."""

    line: list = field(default_factory=list)
    kind: str | None = None
    params: dict | None = None
    lines: list = field(default_factory=list)
    before: list = field(default_factory=list)
    found: bool = False

    def state(self) -> dict:
        return dict(vars(self))

    def _end(self) -> list[dict]:
        if self.kind is None:
            return []
        out = {"type": self.kind, "params": self.params, "content": "\n".join(self.lines).strip(BLANK)}
        self.kind, self.params, self.lines = None, None, []
        return [out]

    def _take(self, line: str) -> list[dict]:
        head = header(line)
        if head:
            done = self._end()
            (self.kind, self.params), self.found, self.before = head, True, []
            return done
        if self.kind is not None and line.strip(BLANK) == "<":
            return self._end()
        if self.kind is not None:
            self.lines.append(line)
        elif not self.found:
            self.before.append(line)
        return []

    def feed(self, piece: str) -> list[dict]:
        first, *rest = piece.split("\n")
        self.line.append(first)
        out = []
        for x in rest:
            out += self._take("".join(self.line))
            self.line = [x]
        return out

    def close(self) -> list[dict]:
        out = [*self._take("".join(self.line)), *self._end()]
        rest, found = "\n".join(self.before).strip(BLANK), self.found
        self.__init__()
        return out if found or not rest else [{"type": "text", "params": None, "content": rest}]


def blocks(pieces: Iterable[str]) -> Iterator[dict]:
    """All blocks of a text that comes in pieces."""
    p = BlockParser()
    for piece in pieces:
        yield from p.feed(piece)
    yield from p.close()
