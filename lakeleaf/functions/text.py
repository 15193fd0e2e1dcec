"""Text expressions: index tokens, profile tokens, Han n-grams, substring matching, API references, truncation."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trimmed from both ends of query words and profile tokens (fixed values).
EDGES = "\"'.,;:!?()[]{}<>"
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: What makes a profile term important (fixed values).
IMPORTANT = "error|错误|响应|权限|auth|token|401|403|500|api|接口|code|/"
IMPORTANT_TERM = re.compile(IMPORTANT)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Combining marks that belong to the word before them and are dropped.
MARKS = (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)
#: Letters with another case that are newer than the index's table of cases, which leaves them as they are.
CASELESS = (
    (0x37F, 0x37F), (0x528, 0x52E), (0x13F8, 0x13FD), (0x1C80, 0x1C88), (0x1C90, 0x1CBF), (0x2C2F, 0x2C2F), (0xA698, 0xA69A), (0xA796, 0xA79E), (0xA7AB, 0xA7AE), (0xA7B0, 0xA7F5), (0xAB70, 0xABBF),
    (0x104B0, 0x104D3), (0x10570, 0x10595), (0x10C80, 0x10CB2), (0x118A0, 0x118BF), (0x16E40, 0x16E5F), (0x1E900, 0x1E921),
)


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """For each character that the index writes otherwise what it writes: the single character that case folding gives,
    the plain letter in place of an ASCII letter with one mark, nothing for MARKS."""
    newer = {c for a, b in CASELESS for c in range(a, b + 1)}
    out = dict.fromkeys(MARKS, "")
    for c in range(0x20000):  # no script beyond has cases
        ch = chr(c)
        if c in newer or not ch.isalnum():
            continue
        one = next((f for f in (ch.casefold(), ch.lower()) if len(f) == 1), ch)
        parts = unicodedata.normalize("NFD", one)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            one = parts[0].lower()
        if one != ch:
            out[c] = one
    return out


def fold(c: Column) -> Column:
    pairs = sorted(folding().items(), key=lambda p: not p[1])  # what is dropped comes last and has no partner
    return F.translate(c, "".join(chr(a) for a, _ in pairs), "".join(b for _, b in pairs))


def fold_of(text: str) -> str:
    return text.translate(folding())


def index_tokens(c: Column) -> Column:
    """Tokens of the full-text index: runs of letters, numbers, private-use signs and the marks on them, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


_WORD = r"(?:[^\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])"
TOKEN = re.compile(f"{_WORD}(?:{_WORD}|[{''.join(map(chr, MARKS))}])*")


def index_tokens_of(text: str) -> list[str]:
    return [fold_of(t) for t in TOKEN.findall(text)]


def trim_space(c: Column) -> Column:
    """White space in Unicode's sense off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_ascii_fold(c: Column, part: str) -> Column:
    """Substring test that folds ASCII case only; the part is taken literally."""
    return F.contains(ascii_lower(c), F.lit(part.translate(str.maketrans(UPPER, LOWER))))


def like_ascii_fold(c: Column, part: str) -> Column:
    """The same with ``%`` and ``_`` in the part as wildcards."""
    pattern = part.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(c).like(f"%{pattern}%")


def profile_tokens(text: Column) -> Column:
    """Runs of letters, digits and ``/_.-``; edges trimmed; two bytes or more, or with a slash."""
    # Of EDGES only the full stop can stand in a run.
    raw = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}/_.\-]+)"), 1), lambda t: F.btrim(t, F.lit(".")))
    return F.filter(raw, lambda t: (F.octet_length(t) >= 2) | F.contains(t, F.lit("/")))


def han_ngrams(text: Column, low: int, high: int) -> Column:
    """Every run of Han signs cut into n-grams: by run, then n, then place."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}+)"), 1)
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
    none = F.array().cast("array<string>")
    of = lambda run: F.flatten(F.transform(sizes, lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))).otherwise(none)))
    return F.flatten(F.transform(runs, of))


def profile_terms(text: Column, least_han: int = 1) -> Column:
    return F.concat(profile_tokens(text), han_ngrams(F.lower(text), least_han, 4))


def skipped(term: Column) -> Column:
    """Terms that aren't ranked: empty, or one sign that isn't Han."""
    return (F.length(term) == 0) | ((F.length(term) == 1) & ~term.rlike(r"\p{IsHan}"))


def api_refs(tokens: Column) -> Column:
    """``METHOD /path`` pairs, paths, status codes and error_code tokens among profile tokens; each once.

    tokens: a column that holds them; the expression itself would be worked out again for every token.
    """
    methods = [F.lit(m) for m in HTTP_METHODS]

    def at(t: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        pair = F.upper(t).isin(*methods) & after.isNotNull() & F.startswith(after, F.lit("/"))
        alone = F.startswith(t, F.lit("/")) | (F.length(t) == 3) & t.rlike(r"^[1-5]\p{Nd}\p{Nd}$") | F.contains(t, F.lit("error_code"))
        return F.when(pair, F.concat(F.upper(t), F.lit(" "), after)).when(alone, t)

    return F.array_distinct(F.filter(F.transform(tokens, at), lambda r: r.isNotNull()))


def one_of(name: str, values: Iterable[str]) -> Column:
    """Whether a column has one of many values: ``isin``, as one expression that is parsed at once."""
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in sorted(set(values))]
    return F.expr(f"`{name}` in ({', '.join(quoted)})") if quoted else F.lit(False)


def non_empty(*values: Column) -> Column:
    """The values in order, trimmed, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.array(*[trim_space(F.coalesce(v, F.lit(""))) for v in values]), lambda v: v != ""))


def snippet_line(content: Column, size: int = 220) -> Column:
    """The first characters on one line."""
    return F.substring(F.translate(content, "\n\r", "  "), 1, size)


# On the driver, or inside Arrow functions ----------------------------------------------------------------------


#: The Han script.
HAN = re.compile(
    r"[\u2e80-\u2e99\u2e9b-\u2ef3\u2f00-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufa6d\ufa70-\ufad9"
    r"\U00016fe2-\U00016fe3\U00016ff0-\U00016ff1\U00020000-\U0002fa1d\U00030000-\U000323af]+"
)


def han_runs_of(text: str) -> list[str]:
    return HAN.findall(text)


def han_ngrams_of(text: str, low: int, high: int) -> list[str]:
    return [run[i : i + n] for run in han_runs_of(text) for n in range(low, high + 1) for i in range(len(run) - n + 1)]


_RUN = regex.compile(r"[\p{L}\p{Nd}/_.\-]+")
_ASCII_RUN = re.compile(r"[A-Za-z0-9/_.\-]+")
_STATUS = regex.compile(r"[1-5]\p{Nd}\p{Nd}")
_STATUSES = re.compile(r"\n([1-5]\d\d)(?=\n)")


def profile_tokens_of(low: str) -> list[str]:
    """``profile_tokens`` of a text that is in small letters."""
    return [t for r in (_ASCII_RUN if low.isascii() else _RUN).findall(low) if len(t := r.strip(".") if "." in r else r) >= 2 or t == "/" or t > "\x7f"]


def api_refs_of(tokens: list[str]) -> list[str]:
    """``api_refs`` of a list of tokens."""
    lines = "\n".join(["", *tokens, ""])
    if "\n/" not in lines and "error_code" not in lines:  # status codes only
        return list(dict.fromkeys(_STATUSES.findall(lines)))
    out: dict[str, None] = {}
    for i, t in enumerate(tokens):
        if i + 1 < len(tokens) and tokens[i + 1].startswith("/") and t.upper() in HTTP_METHODS:
            out[f"{t.upper()} {tokens[i + 1]}"] = None
        elif t.startswith("/") or len(t) == 3 and _STATUS.fullmatch(t) or "error_code" in t:
            out[t] = None
    return list(out)


def cut_bytes(text: str, most: int) -> str:
    """At most so many bytes of UTF-8, never within a character."""
    return text.encode()[: max(0, most)].decode(errors="ignore")


def truncate_paragraphs(text: str, most: int) -> str:
    """Whole paragraphs while their bytes fit (separators don't count); a first one that doesn't fit is cut."""
    if most <= 0 or len(text.encode()) <= most:
        return text
    kept: list[str] = []
    size = 0
    for part in (p.strip() for p in text.split("\n\n")):
        if not part:
            continue
        if size + len(part.encode()) > most:
            break
        kept.append(part)
        size += len(part.encode())
    return "\n\n".join(kept) if kept else cut_bytes(text, most)


def term_snippet(content: str, term: str) -> str:
    """The first hit of a term with 70 bytes before and 90 after it, marked; else the beginning."""
    raw, at = content.encode(), content.lower().encode().find(term.lower().encode())
    size = len(term.encode())
    if not term or at < 0:
        return truncate_paragraphs(content, 220)
    start, end = max(0, at - 70), min(len(raw), at + size + 90)
    text = lambda b: b.decode(errors="replace")
    return ("..." if start else "") + text(raw[start:at]) + "<mark>" + text(raw[at : at + size]) + "</mark>" + text(raw[at + size : end]) + ("..." if end < len(raw) else "")


def _instances(tokens: list[str], phrases: list[list[str]]) -> list[tuple[int, int]]:
    """(place, phrase) wherever a phrase stands, in order."""
    first: dict[str, list[int]] = {}
    for k, p in enumerate(phrases):
        if p:
            first.setdefault(p[0], []).append(k)
    return [(i, k) for i, t in enumerate(tokens) for k in first.get(t, ()) if tokens[i : i + len(phrases[k])] == phrases[k]]


def _best_window(content: str, spans: list[tuple[int, int]], found: list[tuple[int, int]], sizes: list[int], size: int) -> int:
    """The first token of the window that is shown. Windows are tried in the order of the hits: one around the hits that
    lie within ``size`` tokens from each hit, and one from the start of the sentence that the hit is in. A phrase counts
    1000 the first time and 1 again; a sentence's start 100, the text's 120. The first of the best is taken."""
    sentences = [0]
    for i in range(1, len(spans) if found else 0):
        gap = content[spans[i - 1][1] : spans[i][0]]
        if gap[-1:] in (" ", "\t", "\n", "\r") and gap.rstrip(" \t\n\r").endswith((".", ":")):
            sentences.append(i)

    places = [i for i, _ in found]

    def within(first: int) -> list[tuple[int, int]]:
        return found[bisect_left(places, first) : bisect_left(places, first + size)]

    def score(hits: list[tuple[int, int]]) -> int:
        kinds = len({k for _, k in hits})
        return 1000 * kinds + len(hits) - kinds

    best, begin = 0, 0
    for place, _ in found:
        inside = within(place)
        last = inside[-1][0] + sizes[inside[-1][1]]
        at = place - int((size - (last - place)) / 2)  # towards zero
        tries = [(score(inside), max(0, min(at, len(spans) - size)))]
        if len(spans) > size:
            start = sentences[max(0, bisect_right(sentences, place) - 1)]
            if start < place:
                tries.append((score(within(start)) + (100 if start else 120), start))
        for points, at in tries:
            if points > best:
                best, begin = points, at
    return begin


def window_snippet(content: str, phrases: list[list[str]], size: int = 16) -> str:
    """The ``size`` tokens of a text that show its hits best, as full-text indexes choose and mark them; the beginning if
    there are no hits."""
    words = [(m.span(), fold_of(m[0])) for m in TOKEN.finditer(content)]
    spans = [s for s, _ in words]
    sizes = [len(p) for p in phrases]
    found = _instances([t for _, t in words], phrases)
    begin = _best_window(content, spans, found, sizes, size)
    end = begin + size  # the token after the window
    marked: list[list[int]] = []  # hits that overlap are marked together, first and last token
    for place, k in found:
        if marked and place <= marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], place + sizes[k] - 1)
        else:
            marked.append([place, place + sizes[k] - 1])
    out, at = ["..." if begin else ""], spans[begin][0] if begin else 0
    for first, last in marked:
        if begin <= first < end:
            stop = spans[min(last, end - 1)][1]
            out += [content[at : spans[first][0]], "<mark>", content[spans[first][0] : stop], "</mark>"]
            at = stop
    if end >= len(spans):
        return "".join(out) + content[at:]
    return "".join(out) + content[at : max(at, spans[end - 1][1])] + "..."
