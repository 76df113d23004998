"""Questions of a page of text, as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

# Fixed values.
NUMBERED = r"^(?:Q\s*\.?\s*(?:No\.?\s*)?|Question\s+)?(\d{1,2})\s*[.)]\s*(?=\S)"
CAPTIONED = r"^Q\s*\.?\s*(?:No\.?\s*)?(\d{1,2})\b"
ASKS = (
    r"\b(?:discuss|examine|analyse|analyze|elucidate|evaluate|comment|critically|substantiate|illustrate|do you agree|to what extent|account for|bring out|"
    r"how (?:far|does|do|did|has|have)|what (?:are|is|do|was|were)|why (?:is|are|do|did|has))\b"
)
PAGE_NOISE = (
    r"^(?:page\b|p\.?\s*\d|\d{1,3}\s*(?:of|/)\s*\d{1,3}\b|www\.|https?:|©|copyright|all rights|for more|visit\b|download\b|t\.me|telegram|contact\b|scanned by|instagram|youtube|"
    r"marks?\s*obtained|roll\s*no|q\.?\s*booklet|do not write|space for)"
)
LIMITS = r"[\[(][^)\]]*\b\d{2,3}\s*(?:marks?|words?|M)\b[^)\]]*[\])]"
ANSWER = r"\b(?:Ans(?:wer)?\b|Introduction\b|Body\b|Conclusion\b|Solution\b)"
LISTED, HEAD, SPAN, LEAST, MOST = 3, 7, 6, 18, 400

_NUMBERED, _CAPTIONED, _ASKS, _PAGE_NOISE, _LIMITS, _ANSWER = (re.compile(p, re.I | re.A) for p in (NUMBERED, CAPTIONED, ASKS, PAGE_NOISE, LIMITS, ANSWER))


def _one_space(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def question_text(blob: str) -> str:
    """The question that a stretch of lines begins with: up to its limits, its question mark, the answer, or MOST characters."""
    t = re.sub(r"^[)\].,\s-]+", "", _CAPTIONED.sub("", _NUMBERED.sub("", _one_space(blob), count=1), count=1))
    limits = _LIMITS.search(t)
    if limits and limits.start() >= 20:
        return t[: limits.end()].strip()
    mark = t.find("?")
    if 20 <= mark < 500:
        return t[: mark + 1].strip()
    answer = _ANSWER.search(t)
    if answer and answer.start() >= 25:
        return re.sub(r"[.,;:\s-]+$", "", t[: answer.start()].strip())
    return t[:MOST].strip()


def questions_of(page: str) -> Iterator[str]:
    """The questions of a page: each numbered line starts one if there are LISTED of them; else the first of the top lines that reads like one does."""
    lines = [x for x in (_one_space(ln) for ln in page.split("\n")) if x]
    starts = [i for i, ln in enumerate(lines) if _NUMBERED.match(ln) or _CAPTIONED.match(ln)]
    if len(starts) >= LISTED:
        ends = [*starts[1:], min(len(lines), starts[-1] + SPAN)]
        blobs = [" ".join(lines[s:e]) for s, e in zip(starts, ends, strict=True)]
    else:

        def asks(ln: str) -> bool:
            if _PAGE_NOISE.match(ln) or re.fullmatch(r"[^A-Za-z0-9]{0,3}", ln):
                return False
            return bool(_NUMBERED.match(ln) or _CAPTIONED.match(ln)) or (len(ln) > 28 and bool(_ASKS.search(ln[:110])))

        first = next((i for i, ln in enumerate(lines[:HEAD]) if asks(ln)), None)
        blobs = [] if first is None else [" ".join(lines[:HEAD][first : first + SPAN])]
    for b in blobs:
        t = question_text(b)
        if len(t) >= LEAST:
            yield t


@udtf(returnType="question_no: int, question: string", useArrow=True)
class ExtractQuestions:
    """extract_questions(page): the questions of a page's text, numbered from 1; null and empty pages have none, very long ones are taken whole."""

    def eval(self, page: str):
        for i, q in enumerate(questions_of(page or "")):
            yield i + 1, q
