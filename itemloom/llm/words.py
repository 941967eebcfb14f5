"""Ids of whole texts from the ids of their words, which a worker remembers.

A blank before a visible character always begins a piece of a byte-level vocabulary, and a
line end between two visible characters is a piece of its own.  So a text is cut there, and
each word with the blank or line end before it is looked up; words not met before are
encoded together.  Any other white space sends the whole text to the encoder.
"""

from __future__ import annotations

from collections.abc import Callable

#: Words a worker remembers; beyond it they are encoded each time they are met.
REMEMBERED = 600_000


class WordIds:
    """``encode`` gives the ids, as bytes, of each of some texts that stand for themselves."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], specials: dict[str, bytes]):
        self._encode = encode
        self._specials = specials
        self._known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids of a whole text; a special token's string in it is that token."""
        for special, own in self._specials.items():
            if special in text:
                return own.join(self.ids(part) for part in text.split(special))
        if not text:
            return b""
        if " \n" in text:
            return self._encode([text])[0]
        first, *rest = text.replace("\n", " \n").split(" ")
        known = self._known
        found = [known.get(word) for word in rest]
        if None in found:
            new = {word for word, ids in zip(rest, found) if ids is None}
            for word in new:
                inner = word[1:] if word[:1] == "\n" else word
                if not inner or inner[0].isspace():
                    return self._encode([text])[0]
            new = list(new)
            met = dict(zip(new, self._encode([word if word[0] == "\n" else " " + word for word in new])))
            if len(known) < REMEMBERED:
                known.update(met)
            found = [met[word] if ids is None else ids for word, ids in zip(rest, found)]
        return (self._encode([first])[0] if first else b"") + b"".join(found)
