"""FCS TEXT segments: tokenising, typing, required keywords."""

from __future__ import annotations

import json
import re
import uuid

from ..errors import FormatError

#: Keywords that must be present, by version.
REQUIRED = {
    "FCS1.0": (),
    "FCS2.0": ("$BYTEORD", "$DATATYPE", "$MODE", "$NEXTDATA", "$PAR"),
    "FCS3.0": ("$BEGINANALYSIS", "$BEGINDATA", "$BEGINSTEXT", "$BYTEORD", "$DATATYPE", "$ENDANALYSIS", "$ENDDATA", "$ENDSTEXT", "$MODE", "$NEXTDATA", "$PAR", "$TOT"),
    "FCS3.1": ("$BEGINANALYSIS", "$BEGINDATA", "$BEGINSTEXT", "$BYTEORD", "$DATATYPE", "$ENDANALYSIS", "$ENDDATA", "$ENDSTEXT", "$MODE", "$NEXTDATA", "$PAR", "$TOT"),
    "FCS3.2": ("$BEGINDATA", "$BYTEORD", "$CYT", "$DATATYPE", "$ENDDATA", "$NEXTDATA", "$PAR", "$TOT"),
    "FCS4.0": ("$BEGINDATA", "$BYTEORD", "$DATATYPE", "$ENDDATA", "$NEXTDATA", "$PAR", "$DATE", "$ETIM", "$CYT", "$BTIM", "$TOT"),
}

INTEGERS = {"$PAR", "$TOT", "$BEGINDATA", "$ENDDATA", "$BEGINANALYSIS", "$ENDANALYSIS", "$BEGINSTEXT", "$ENDSTEXT", "$NEXTDATA", "$ABRT", "$LOST", "$CSMODE", "$CSBITS"}
BYTES = {"$BYTEORD", "$DATATYPE"}
MATRICES = {"$SPILLOVER", "$SPILL", "$COMP"}
_PARAMETER = re.compile(r"^\$?[PGR](\d+)([A-Z]+)$")


def tokenize(text: str) -> dict[str, str]:
    """Key-value pairs of a TEXT segment: its first character delimits, doubled it stands for itself; keys get a ``$``."""
    if not text:
        raise FormatError("empty TEXT segment")
    mark, body = text[0], text[1:]
    parts, part, i = [], [], 0
    while i < len(body):
        if body[i] != mark:
            part.append(body[i])
        elif i + 1 < len(body) and body[i + 1] == mark and part:
            part.append(mark)
            i += 1
        else:
            parts.append("".join(part))
            part = []
        i += 1
    if part:
        parts.append("".join(part))
    return {normal_key(k): v.strip() for k, v in zip(parts[::2], parts[1::2], strict=False)}


def normal_key(key: str) -> str:
    key = key.strip().upper()
    return key if key == "GUID" or key.startswith("$") else "$" + key


def number(s: str) -> float:
    return float(s.strip().replace(",", "."))


def _pair(v: str) -> tuple[float, float]:
    p = v.split(",")
    if len(p) == 4:
        p = [f"{p[0]}.{p[1]}", f"{p[2]}.{p[3]}"]
    if len(p) != 2:
        raise ValueError(v)
    return float(p[0]), float(p[1])


def matrix(v: str) -> dict:
    p = [x.strip() for x in v.split(",")]
    n = int(p[0])
    if n <= 0 or len(p) != 1 + n + n * n:
        raise FormatError(f"matrix of {n} has {len(p)} parts")
    return {"n": n, "names": p[1 : n + 1], "values": [float(x) for x in p[n + 1 :]]}


def _display(v: str) -> dict:
    kind, low, high = v.split(",")
    if kind not in ("Linear", "Logarithmic"):
        raise ValueError(v)
    return {"kind": kind, "low": number(low), "high": number(high)}


_SUFFIX = {
    "B": int, "R": int, "V": number, "G": number, "E": _pair, "D": _display, "F": str, "N": str, "S": str, "TYPE": str, "DET": str, "TAG": str,
    "ANALYTE": str, "FEATURE": str, "P": str, "T": str, "W": lambda v: [_pair(x) for x in v.split(";")], "DATATYPE": {"I": 0, "F": 1, "D": 2}.__getitem__,
    "DISPLAY": lambda v: {"lin": "LIN", "log": "LOG"}[v.strip().lower()[:3]],
    "L": lambda v: [number(x) for x in v.strip("() ").split(",")],
    "CALIBRATION": lambda v: (number(v.split(",")[0]), v.split(",")[1].strip()),
}


def typed(key: str, value: str) -> tuple[str, object]:
    """(kind, value): int, float, string, byte, mixed, or other for what has no type or does not parse."""
    key = normal_key(key)
    try:
        if key in INTEGERS:
            return "int", int(value.strip())
        if key in BYTES:
            return "byte", value.strip()
        if key in MATRICES:
            return "mixed", matrix(value)
        if key == "$VOL":
            return "float", number(value)
        if m := _PARAMETER.match(key):
            parse = _SUFFIX.get(m[2])
            if parse is None:
                return "other", value
            got = parse(value.strip())
            return ("int" if isinstance(got, int) else "float" if isinstance(got, float) else "string" if isinstance(got, str) else "mixed"), got
    except (ValueError, KeyError, IndexError, FormatError):
        return "other", value
    return ("string" if key.startswith("$") or key == "GUID" else "other"), value


def missing(version: str, keywords) -> list[str]:
    if version not in REQUIRED:
        raise FormatError(f"unknown version {version!r}")
    return [k for k in REQUIRED[version] if k not in keywords]


def is_uuid4(value: str) -> bool:
    try:
        return uuid.UUID(value).version == 4
    except ValueError:
        return False


def as_json(keywords: dict[str, str]) -> str:
    """All keywords as one JSON object; an error for a file without any."""
    if not keywords:
        raise FormatError("no keywords")
    return json.dumps(keywords, sort_keys=True, ensure_ascii=False)


def with_parameter(keywords: dict[str, str], name: str, label: str | None = None, bits: int = 32, most: float = 262144) -> dict[str, str]:
    """The keywords of a file that has one more parameter at the end."""
    if any(p["name"] == name for p in parameters(keywords)):
        raise FormatError(f"parameter {name!r} exists")
    n = int(keywords["$PAR"]) + 1
    own = {f"$P{n}N": name, f"$P{n}B": str(bits), f"$P{n}R": f"{most:g}", f"$P{n}E": "0,0"} | ({f"$P{n}S": label} if label else {})
    return keywords | {"$PAR": str(n)} | own


def guid(keywords: dict[str, str]) -> str:
    """The file's GUID, whichever key it stands under; a new one if it has none."""
    return keywords.get("GUID") or keywords.get("$GUID") or str(uuid.uuid4())


def spillover(keywords: dict[str, str]) -> dict | None:
    """The first of $SPILLOVER, $SPILL, $COMP; None without any, an error if malformed."""
    for k in ("$SPILLOVER", "$SPILL", "$COMP"):
        if k in keywords:
            return matrix(keywords[k])
    return None


def parameters(keywords: dict[str, str]) -> list[dict]:
    """One row a parameter, in order."""
    out = []
    for i in range(1, int(keywords["$PAR"]) + 1):
        name = keywords.get(f"$P{i}N") or f"P{i}"
        wave = typed(f"$P{i}L", keywords[f"$P{i}L"])[1] if f"$P{i}L" in keywords else None
        scatter = any(k in name for k in ("FSC", "SSC", "Time"))
        out.append({
            "number": i, "name": name, "label": keywords.get(f"$P{i}S") or name, "transform": "linear" if scatter else "arcsinh",
            "range": float(keywords[f"$P{i}R"]) if keywords.get(f"$P{i}R", "").strip().isdigit() else None,
            "wavelength": int(wave[0]) if isinstance(wave, list) and wave else None,
        })
    return out
