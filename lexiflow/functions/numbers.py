"""Numbers, dates, times, money and counts in Korean words."""

from __future__ import annotations

import re
from collections.abc import Callable

from .vector import each

#: Sino-Korean digits and units, native numerals, their forms before counters, counters, months.
DIGITS = ["영", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]
SMALL, LARGE = ["", "십", "백", "천"], ["", "만", "억", "조", "경"]
NATIVE_ONES = ["", "하나", "둘", "셋", "넷", "다섯", "여섯", "일곱", "여덟", "아홉"]
NATIVE_TENS = ["", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔"]
BEFORE_COUNTER = {"하나": "한", "둘": "두", "셋": "세", "넷": "네", "스물": "스무"}
COUNTERS = ["시간", "시", "명", "개", "살", "마리", "권", "잔", "병", "장", "대", "번", "벌", "송이", "그루"]
UNITS = {"km": "킬로미터", "cm": "센티미터", "mm": "밀리미터", "kg": "킬로그램", "m": "미터", "g": "그램", "%": "퍼센트", "℃": "도"}
MONTHS = {6: "유월", 10: "시월"}


def sino(n: int, spaced: bool = False) -> str:
    """Sino-Korean reading; every digit and unit apart if ``spaced``, which keeps the one before ten thousand."""
    if n == 0:
        return DIGITS[0]
    said = []
    for k in range(len(LARGE) - 1, -1, -1):
        part = n // 10 ** (4 * k) % 10000
        units = [x for j in (3, 2, 1, 0) if (d := part // 10**j % 10) for x in ("" if d == 1 and j else DIGITS[d], SMALL[j]) if x]
        if units:
            said += [*([] if units == ["일"] and k == 1 and not spaced else units), *([LARGE[k]] if k else [])]
    return (" " if spaced else "").join(said)


def native(n: int, counter: bool = False) -> str:
    """Native reading of 1 to 99, others Sino-Korean; the short forms before a counter."""
    if not 0 < n < 100:
        return sino(n)
    tens, ones = NATIVE_TENS[n // 10], NATIVE_ONES[n % 10]
    if counter:
        ones = BEFORE_COUNTER.get(ones, ones)
        tens = BEFORE_COUNTER.get(tens, tens) if not ones else tens
    return tens + ones


def decimal(text: str, spaced: bool = False) -> str:
    """A number with commas, sign and fraction."""
    sign, text = ("마이너스 ", text[1:]) if text[0] == "-" else ("", text)
    whole, _, part = text.replace(",", "").partition(".")
    point, gap = (" 점 ", " ") if spaced else ("점 ", "")
    return sign + sino(int(whole or 0), spaced) + (point + gap.join(DIGITS[int(d)] for d in part) if part else "")


_NUMBER = r"-?\d(?:[\d,]*\d)?(?:\.\d+)?"


def verbaliser(spaced: bool = False, half_hours: bool = False, months: bool = True, counters: bool = True) -> Callable[[str], str]:
    """A function that puts numbers of a text into words; the switches are those in which the variants differ."""
    month = lambda n: MONTHS.get(n, sino(n) + "월") if months else sino(n) + "월"
    rules = [
        (r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", lambda m: f"{sino(int(m[1]))}년 {month(int(m[2]))} {sino(int(m[3]))}일"),
        (r"(\d{1,2}):(\d{2})(?!\d)", lambda m: f"{native(int(m[1]), True)}시" + (" 반" if half_hours and m[2] == "30" else f" {sino(int(m[2]))}분" if int(m[2]) else "")),
        *([(r"(\d{1,2})\s*시\s*30\s*분", lambda m: f"{native(int(m[1]), True)}시 반")] if half_hours else []),
        (r"(\d{1,2})\s*월(?=\s|\d|$)", lambda m: month(int(m[1]))),
        (rf"[₩￦]\s*({_NUMBER})", lambda m: decimal(m[1], spaced) + " 원"),
        (rf"[$]\s*({_NUMBER})", lambda m: decimal(m[1], spaced) + " 달러"),
        (rf"({_NUMBER})\s*({'|'.join(UNITS)})(?![A-Za-z])", lambda m: f"{decimal(m[1], spaced)} {UNITS[m[2]]}"),
        *([(rf"(\d{{1,2}})\s*({'|'.join(COUNTERS)})", lambda m: f"{native(int(m[1]), True)} {m[2]}" if m[2] != "시" else f"{native(int(m[1]), True)}시")] if counters else []),
        (rf"({_NUMBER})", lambda m: decimal(m[1], spaced)),
    ]
    compiled = [(re.compile(p), f) for p, f in rules]

    def run(text: str) -> str:
        for pattern, f in compiled:
            text = pattern.sub(f, text)
        return text

    return run


#: Variants: every unit apart (H21), unspaced (H22), with dates and money (H23), for speech with half hours.
VARIANTS = {"spaced": verbaliser(spaced=True), "plain": verbaliser(counters=False, months=False), "full": verbaliser(), "speech": verbaliser(half_hours=True)}


def verbalised(variant: str = "full"):
    return each(VARIANTS[variant], "string")


def _cleaned(text: str) -> str:
    return re.sub(r"\s+", " ", VARIANTS["speech"](text)).strip()


#: Cleaners by name (J1): a chain is applied from left to right.
CLEANERS: dict[str, Callable[[str], str]] = {
    "lowercase": str.lower,
    "collapse": lambda t: re.sub(r"\s+", " ", t).strip(),
    "numbers": VARIANTS["speech"],
    "korean": _cleaned,
}


def cleaned(names: list[str]):
    """A column function for a chain of cleaners; an unknown name is an error."""
    chain = [CLEANERS[n] for n in names]

    def run(text: str) -> str:
        for f in chain:
            text = f(text)
        return text

    return each(run, "string")
