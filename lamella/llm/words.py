"""Words of a text as problem 7 means them: what is left when spelling variants of the carrier are taken away."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

_BLOCK = re.compile(r"</?(?:p|br|hr|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|pre|section|article)\b[^<>]*>", re.I)
_INLINE = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
#: UTF-8 read as Windows-1252: a lead character and its continuation characters.
_CONT = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_TWICE = re.compile(f"[Â-ß][{_CONT}]|[à-ï][{_CONT}]{{2}}|[ð-ô][{_CONT}]{{3}}")
_BREAK = re.compile("(?<=[^\\W_])[-‐‑­¬][ \t​]*(?:\r\n|[\n\r  \u0085\x0b\x0c])[\\s>|​﻿]*(?=[^\\W_])")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_MARKS = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿]")
_WORD = re.compile(r"[^\W_]+")


def _once(m: re.Match) -> str:
    raw = b"".join(bytes((ord(c),)) if ord(c) < 256 else c.encode("cp1252") for c in m[0])
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits after undoing markup, entities, double encoding, invisible characters, words cut
    at a line end, compatibility forms and case. Null and blank texts have none."""
    if not text:
        return []
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _TWICE.sub(_once, text)
        text = unicodedata.normalize("NFC", text)
    text = _BREAK.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        text = _MARKS.sub("", text)
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


class WordHash(dict):
    """64-bit hashes of words, alike on every machine; keeps those seen."""

    def __init__(self, keep: int = 500_000):
        import xxhash

        self.of, self.keep = xxhash.xxh64_intdigest, keep

    def __missing__(self, word: str) -> int:
        h = self[word] = self.of(word)
        return h

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self) > self.keep:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k following words; mixed, so that the least of a window is as good as drawn by lot."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept k-grams: the least of each run of ``window`` of them (the last one if equal), each once.

    Any two texts that share window + k - 1 words in a row keep a k-gram of that run in both.
    """
    if len(g) < window:
        return np.empty(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(g[::-1], window)
    at = len(g) - 1 - (np.arange(len(runs)) + runs.argmin(axis=1))
    return np.unique(at)
