"""One written time to one UTC instant (microseconds since 1970), or None where it doesn't denote exactly one."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)

# Names of the months, by language, January first.
_MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
}
_MONTH = {name: i for names in _MONTHS.values() for i, name in enumerate(names.split(), 1)}
_MONTH |= {name[:3]: i for name, i in list(_MONTH.items())[:12]} | {"sept": 9, "mrz": 3, "maerz": 3, "okt": 10, "dez": 12}

#: Languages whose short dates have the month before the day.
_MONTH_FIRST = {"en_us", "en_ph", "ja_jp", "ja", "zh_cn", "zh_tw", "ko_kr", "hu_hu", "fa_ir"}

_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"\s*(?P<z>[Zz]|\[?[A-Za-z][A-Za-z_]*(?:/[A-Za-z0-9_+\-]+)+\]?|\[[A-Za-z]+\]|(?:UTC|GMT)?[+\-]\d{2}(?::?\d{2})?(?:\s*[\[(][A-Za-z/_+\-0-9]+[\])])?|[A-Za-z]{2,5}|)"
_WEEKDAY = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_FORMS = [
    re.compile(p + "$")
    for p in (
        rf"(?P<y>\d{{4}})[\-/.](?P<m>\d{{1,2}})[\-/.](?P<d>\d{{1,2}})(?:[Tt]|\s+|,\s*){_CLOCK}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt ]?(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,](?P<f>\d+))?{_ZONE}",
        rf"(?P<a>\d{{1,2}})[\-/.](?P<b>\d{{1,2}})[\-/.](?P<y>\d{{4}}),?\s+{_CLOCK}{_ZONE}",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|º|st|nd|rd|th)?[\s\-](?:de\s+)?(?P<mon>[^\W\d_]+)\.?[\s\-](?:de\s+)?(?P<y>\d{{4}}),?\s+(?:um\s+|at\s+|às\s+)?{_CLOCK}(?:\s*Uhr)?{_ZONE}",
        rf"{_WEEKDAY}(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_ZONE}",
        rf"{_WEEKDAY}(?P<mon>[^\W\d_]+)\s+(?P<d>\d{{1,2}})\s+{_CLOCK}(?:\s+(?P<z2>[A-Z]{{2,5}}))?\s+(?P<y>\d{{4}}){_ZONE}",
        r"(?P<y>\d{4})年(?P<m>\d{1,2})月(?P<d>\d{1,2})日\s*(?P<H>\d{1,2})[時:](?P<M>\d{1,2})分?(?:[:]?(?P<S>\d{1,2})秒?)?(?P<z>)",
    )
]
_NUMBER = re.compile(r"[+]?(\d+)(?:\.(\d+))?(?:\s+[+\-]\d{2}:?\d{2})?$")
_OFFSET = re.compile(r"(?:UTC|GMT)?([+\-])(\d{2}):?(\d{2})?\b")


@lru_cache(maxsize=4096)
def zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _at_abbreviation(wall: datetime, abbreviation: str, name: str | None) -> datetime | None:
    """UTC of a wall-clock time under an abbreviation that the zone used then; of a repeated hour it tells which one is meant."""
    tz = zone(name) if name else None
    if tz is None:
        return None
    sides = [wall.replace(tzinfo=tz, fold=k) for k in (0, 1)]
    shifts = {at.utcoffset() for at in sides if at.tzname() == abbreviation}
    return wall - shifts.pop() if len(shifts) == 1 else None


def _offset(text: str) -> timedelta | None:
    m = _OFFSET.match(text)
    if not m:
        return None
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    if int(m[3] or 0) > 59 or minutes > 18 * 60:
        return None
    return timedelta(minutes=-minutes if m[1] == "-" else minutes)


def _at_wall(wall: datetime, name: str | None) -> datetime | None:
    """UTC of a wall-clock time, unless a clock change skipped or repeated it."""
    tz = zone(name) if name else None
    if tz is None:
        return None
    first, second = (wall.replace(tzinfo=tz, fold=k).utcoffset() for k in (0, 1))
    return wall - first if first == second else None


def _number(whole: str, fraction: str | None) -> int | None:
    n = int(whole)
    if n <= 0:
        return None
    if n < 10**11:
        return n * 1_000_000 + int(((fraction or "") + "000000")[:6])
    if n < 10**14:
        return n * 1000 + int(((fraction or "") + "000")[:3])
    if n < 10**17:
        return n
    return n // 1000 if n < 10**20 else None


def instant(raw: str | None, tz_name: str | None, locale: str | None) -> int | None:
    """The instant raw denotes. Zone-less times are wall-clock times of tz_name, abbreviations those of tz_name, and
    day and month are in the order of locale. None for what is missing, unreadable, doesn't exist or isn't one instant."""
    if raw is None:
        return None
    text = raw.strip().strip("﻿\"'").strip()
    if not text or not any(c.isdigit() for c in text):
        return None
    m = _NUMBER.match(text)
    # 14 digits that don't start as an instant in milliseconds would are YYYYMMDDhhmmss.
    if m and not (len(m[1]) == 14 and not m[2]) and not (len(m[1]) == 12 and m[1][:2] in ("19", "20")):
        return _number(m[1], m[2])
    for form in _FORMS:
        m = form.match(text)
        if m:
            break
    else:
        return None
    g = m.groupdict()
    try:
        if g.get("mon"):
            month, day = _MONTH.get(g["mon"].lower()), int(g["d"])
        elif g.get("a"):
            first, second = int(g["a"]), int(g["b"])
            if not locale:
                return None
            month, day = (first, second) if locale.lower().replace("-", "_") in _MONTH_FIRST else (second, first)
        else:
            month, day = int(g["m"]), int(g["d"])
        hour = int(g["H"])
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if g["ap"] in "Pp" else 0)
        wall = datetime(int(g["y"]), month, day, hour, int(g["M"]), int(g["S"] or 0), int(((g.get("f") or "") + "000000")[:6]))
        at = _placed(wall, (g.get("z") or g.get("z2") or "").strip(), tz_name)
        return None if at is None else (at - _EPOCH) // _US
    except (ValueError, TypeError, OverflowError):
        return None


def _placed(wall: datetime, z: str, tz_name: str | None) -> datetime | None:
    if not z:
        return _at_wall(wall, tz_name)
    if z in ("Z", "z", "UTC", "GMT", "[UTC]", "[GMT]", "utc", "gmt"):
        return wall
    if "+" in z[:4] or "-" in z[:4]:
        shift = _offset(z)
        return None if shift is None else wall - shift
    if "/" in z or z.startswith("["):
        return _at_wall(wall, z.strip("[]"))
    return _at_abbreviation(wall, z, tz_name)


def utc_text(us: int) -> str:
    return (datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=us)).isoformat()
