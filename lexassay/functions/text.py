"""Views of a text that keep the way back to its stored characters."""

from __future__ import annotations

# Characters that draw nothing.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufe00\ufe01\ufe02\ufe0e\ufe0f\ufeff"
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_TO_ASCII = {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys(map(ord, BLANKS), " ") | dict.fromkeys(map(ord, INVISIBLE), "\0")


def plain_view(text: str) -> tuple[str, list[int] | None]:
    """The text with width forms and blanks in ASCII and without invisible characters, and the place of
    each character in the stored text (None if nothing was left out)."""
    if text.isascii():
        return text, None
    view = text.translate(_TO_ASCII)
    if "\0" not in view:
        return view, None
    at = [i for i, c in enumerate(view) if c != "\0"]
    return view.replace("\0", ""), at
