"""The type and title of a filing from its file name, its folder and the top of its text, as columns.

Rules are patterns in order; of all rules that match, the earliest place wins, then the earlier rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "Other"

# Types of filings with the patterns that name them, the more specific ones first.
TYPES = [
    ("Bill of Review", [r"bill\s+of\s+review"]),
    ("Return of Service", [r"return\s+of\s+service"]),
    ("Demand Letter", [r"demand\s+letter"]),
    ("Clerk's Record", [r"clerk'?s?\s+record", r"\bC\.?\s*R\.?(?=\s+(?:vol(?:ume)?|page|p\.?|\d))"]),
    ("Reporter's Record", [r"reporter'?s?\s+record", r"\bR\.?\s*R\.?(?=\s+(?:vol(?:ume)?|page|p\.?|\d))", r"\b(?:supp(?:lemental|lement)?\.?)\s+R\.?\s*R\.?\b"]),
    ("Transcript", ["transcript", r"\bdeposition\b"]),
    ("Settlement", ["settlement", r"\bmediat"]),
    ("Affidavit", ["affidavit", r"\bsworn\s+(?:statement|declaration)"]),
    ("Subpoena", ["subpoena", r"\bduces\s+tecum\b"]),
    ("Designation", ["designation"]),
    ("Supplement", ["supplement"]),
    ("Petition", ["petition"]),
    ("Judgment", ["judgment", r"\bjudgement\b"]),
    ("Decree", ["decree"]),
    ("Objection", ["objection"]),
    ("Request", [r"request\b"]),
    ("Motion", ["motion", r"\bemergency\s+mot"]),
    ("Brief", ["brief"]),
    ("Response", ["response", r"\bopposition\b"]),
    ("Reply", ["reply"]),
    ("Order", [r"\border\b", r"\bruling\b"]),
    ("Notice", ["notice", r"\bnotification\b"]),
    ("Letter", ["letter", r"\bcorrespondence\b"]),
]
MODIFIERS = r"\b(?:supplemental|amended|emergency|original|corrected|revised|proposed|preliminary|final)\b"
PARTIES = r"\b(?:petitioner'?s?|respondent'?s?|appellant'?s?|appellee'?s?|plaintiff'?s?|defendant'?s?|movant'?s?|applicant'?s?|claimant'?s?)\b"
BOUNDARY = r"\b(?:in\s+support\s+of|in\s+opposition\s+to|in\s+response\s+to|in\s+reply\s+to|regarding|concerning|re:|for\s+(?:a|the)?)\b"
CASE_NUMBER = r"^[A-Z]-\d+-[A-Z]+-\d+-\d+\s*[-–—]\s*"
DOCKET = r"^[A-Z]{1,4}[-_.]\d{2,6}[-_.]\d{3,8}\s*[-–—]\s*"
STRIPPED = [
    CASE_NUMBER,
    DOCKET,
    r"^\d{4}[-_.]\d{2}[-_.]\d{2}\s*[-–—]?\s*",
    r"^\d+[-_.]\s*",
    r"\s*[-–—_]\s*(?:signed|filed|final|copy|scan(?:ned)?|compressed)\s*$",
    r"\s*[-–—_]?\s*V\d+\s*$",
    r"\s*\(\d+\)\s*$",
    r"\s*[-–—]\s*\d+\s*$",
    r"\s*compressed\s*$",
]
# Titles at the top of a text with their type and confidence; the first of two at one place wins.
TITLES = [
    (r"\bRESPONDENT'?S?\s+RESPONSE\b", "Response", "high"),
    (r"\bRESPONSE\s+IN\s+OPPOSITION\s+TO\b", "Response", "high"),
    (r"\bRESPONSE\s+TO\b", "Response", "high"),
    (r"\bREPLY\s+(?:TO|IN\s+SUPPORT)\b", "Response", "high"),
    (r"\bSUR-?REPLY\b", "Response", "high"),
    (r"\bOPPOSED\s+MOTION\b", "Motion", "high"),
    (r"\bEMERGENCY\s+MOTION\b", "Motion", "high"),
    (r"\bMOTION\s+TO\s+\w+", "Motion", "high"),
    (r"\bMOTION\s+FOR\s+\w+", "Motion", "high"),
    (r"\bMOTION\s+IN\s+LIMINE\b", "Motion", "high"),
    (r"\bPROPOSED\s+ORDER\b", "Order", "high"),
    (r"\bORDER\s+ON\b", "Order", "high"),
    (r"\bORDER\s+GRANTING\b", "Order", "high"),
    (r"\bORDER\s+DENYING\b", "Order", "high"),
    (r"(?:^|[\s>])ORDER(?:\s|$)", "Order", "medium"),
    (r"\bAPPELLANT'?S?\s+BRIEF\b", "Brief", "high"),
    (r"\bAPPELLEE'?S?\s+BRIEF\b", "Brief", "high"),
    (r"\bBRIEF\s+(?:OF|FOR|IN)\b", "Brief", "high"),
    (r"\bREPORTER'?S?\s+RECORD\b", "Reporter's Record", "high"),
    (r"\bCOURT\s+REPORTER\b", "Reporter's Record", "high"),
    (r"\bCLERK'?S?\s+RECORD\b", "Clerk's Record", "high"),
    (r"\bSUBPOENA\b", "Subpoena", "high"),
    (r"\bAFFIDAVIT\s+(?:OF|IN\s+SUPPORT)\b", "Affidavit", "medium"),
    (r"\bDECLARATION\s+OF\b", "Affidavit", "medium"),
    (r"\bJUDGMENT\b", "Judgment", "medium"),
    (r"\bNOTICE\s+OF\s+\w+", "Notice", "high"),
    (r"\bREQUEST\s+FOR\s+ADMISSIONS?\b", "Request", "high"),
    (r"\bDEEMED\s+ADMISSIONS?\b", "Request", "high"),
    (r"\bRFA\b", "Request", "medium"),
    (r"\bBILL\s+OF\s+REVIEW\b", "Bill of Review", "medium"),
    (r"(?:^|[\s>])PETITION(?:\s|$)", "Petition", "medium"),
]
CAPTION = [
    (r"(?i)\b(?:CAUSE\s+)?NO(?:\.\s*|\s+)[A-Z0-9][A-Z0-9-]{2,}", " "),
    (r"(?i)\bIN\s+THE\b[^\n]*?\b(?:DISTRICT|COUNTY|JUDICIAL|APPELLATE|SUPREME)\b[^\n]*?\bTEXAS\b", " "),
    (r"(?im)^[^\n]*\bCOURT\s+OF\s+[A-Z][A-Z\s,'-]*\bTEXAS\b", " "),
    (r"(?i)\b(?:PETITIONER|RESPONDENT|PLAINTIFF|DEFENDANT|APPELLANT|APPELLEE)\s*[,§]", " "),
    (r"§+", " "),
    (r"\s+", " "),
]
PREAMBLE = [
    r"^(?:IN\s+THE|CAUSE\s+NO|NO\.\s*\d|CASE\s+NO|COUNTY\s+OF|STATE\s+OF|DISTRICT\s+COURT)",
    r"^(?:VS?\.?\s*$|PLAINTIFF|DEFENDANT|PETITIONER|RESPONDENT|APPELLANT|APPELLEE)",
    r"^\d+(?:ST|ND|RD|TH)\s+(?:JUDICIAL|DISTRICT)",
]
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "of", "to", "in", "on", "at", "by", "with"]


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(f"(?i){pattern}"))


def _at(text: Column, pattern: str) -> Column:
    """The place of the first match, from 1; 0 without one."""
    return F.regexp_instr(text, F.lit(f"(?i){pattern}"))


def _without(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", ""), patterns, text)


def _first_of(found: list[Column]) -> Column:
    """The smallest of the structs that are not null; the arrays are as long as the list of rules."""
    return F.array_min(F.array_compact(F.array(*found)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spaced_words(name: Column) -> Column:
    """'PetitionToStrike' as 'Petition To Strike'."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def base_name(path: Column) -> Column:
    """The last part of a path, without its extension."""
    last = F.substring_index(path, "/", -1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def _named_types() -> list[tuple[int, str, str]]:
    return [(i, kind, p) for i, (kind, patterns) in enumerate(TYPES) for p in patterns]


def _listed_type(text: Column) -> Column:
    """The first type in the list that a text names, wherever."""
    return F.coalesce(*[F.when(_has(text, p), F.lit(kind)) for _, kind, p in _named_types()])


def filing_type(file_name: Column, folder: Column | None = None, header: Column | None = None) -> Column:
    """(type, confidence) of a file name, with a folder's name and the text's top as further signs.

    The earliest type that the name gives before words like 'in support of' counts, not those that are part of a
    modifier or of a party's role; else the earliest in the whole name; else the folder's, else that of the first 500
    characters. Signs that agree raise the confidence. Null names and headers give no sign.
    """
    name = base_name(F.coalesce(file_name, F.lit("")))
    plain = F.trim(_without(spaced_words(name), r"^Cause\s+No\.?\s*", CASE_NUMBER, DOCKET, r"^\s*[-–—]\s*"))
    bare = lambda t: F.coalesce(F.nullif(F.trim(F.regexp_replace(t, f"(?i){PARTIES}", "")), F.lit("")), t)  # noqa: E731  every role goes, unless nothing else is left
    main = lambda t: _let(_at(t, BOUNDARY), lambda cut: F.when(cut > 1, F.trim(F.substring(t, F.lit(1), cut - 1))).otherwise(t))
    by_name = _let(plain, lambda t: _let(bare(t), lambda t: F.coalesce(_let(main(t), lambda m: _earliest(m, True)), _earliest(t, False))))
    none = F.lit(None).cast("string")
    by_folder = none if folder is None else _listed_type(folder)
    by_header = none if header is None else _let(F.substring(header, 1, 500), _listed_type)

    def told(signs: Column) -> Column:
        kind = F.coalesce(signs["name"], signs["folder"], signs["header"])
        agree = reduce(Column.__add__, [F.coalesce((signs[x] == kind).cast("int"), F.lit(0)) for x in ("name", "folder", "header")])
        base = F.when(signs["name"].isNotNull(), 0.85).when(signs["folder"].isNotNull(), 0.75).otherwise(0.60)
        sure = F.when(agree >= 3, F.least(base + 0.12, F.lit(0.99))).when(agree == 2, F.least(base + 0.08, F.lit(0.97))).otherwise(base)
        return F.struct(F.coalesce(kind, F.lit(OTHER)).alias("type"), F.round(F.when(kind.isNull(), 0.2).otherwise(sure), 2).alias("confidence"))

    return _let(F.struct(by_name.alias("name"), by_folder.alias("folder"), by_header.alias("header")), told)


def _earliest(text: Column, strict: bool) -> Column:
    """The type whose pattern matches first, of equal places the first listed; ``strict`` leaves out modifiers in the first half."""

    def place(i: int, kind: str, p: str) -> Column:
        def judged(at: Column) -> Column:
            around = F.substring(text, F.greatest(at - 1, F.lit(1)), F.lit(len(kind) + 12) + F.when(at > 1, 1).otherwise(0))
            off = _has(around, f"(?:{MODIFIERS}|{PARTIES})") & (at - 1 < F.length(text) / 2) if strict else _has(around, PARTIES)
            return F.when((at > 0) & ~off, F.struct(at.alias("at"), F.lit(i).alias("i"), F.lit(kind).alias("kind")))

        return _let(_at(text, p), judged)

    return _first_of([place(*rule) for rule in _named_types()])["kind"]


def header_type(header: Column) -> Column:
    """(type, confidence, matched) of the title that stands first in the first 2,000 characters without their caption; null without one."""
    top = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), CAPTION, F.substring(header, 1, 2000))

    def first(top: Column) -> Column:
        found = []
        for i, (p, kind, sure) in enumerate(TITLES):
            told = F.struct(_at(top, p).alias("at"), F.lit(i).alias("i"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.trim(F.regexp_extract(top, f"(?i){p}", 0)).alias("matched"))
            aside = lambda t: _has(F.substring(top, F.greatest(t["at"] - 30, F.lit(1)), F.least(t["at"] - 1, F.lit(30))), r"\bin\s+support\s+of\b") if kind == "Notice" else F.lit(False)  # noqa: B023, E731
            found.append(_let(told, lambda t: F.when((t["at"] > 0) & ~aside(t), t)))  # noqa: B023
        return F.when(F.length(top) >= 5, _let(_first_of(found), lambda t: F.when(t.isNotNull(), F.struct(t["type"], t["confidence"], t["matched"]))))

    return _let(F.substring(F.trim(top), 1, 1000), first)


def hybrid_type(file_name: Column, header: Column, folder: Column | None = None) -> Column:
    """(type, source, confidence): a sure title at the top of the text wins; a less sure one only where the name is no
    better than a petition, a bill of review or nothing; else the name and folder."""
    told = lambda kind, source, sure: F.struct(kind.alias("type"), F.lit(source).alias("source"), sure.alias("confidence"))

    def of(both: Column) -> Column:
        name, top = both["name"], both["top"]
        weak = name["type"].isin("Petition", "Bill of Review", OTHER) & (top["type"] != name["type"])
        return (
            F.when(top["confidence"] == "high", told(top["type"], "header", F.lit(0.95)))
            .when((top["confidence"] == "medium") & weak, told(top["type"], "hybrid", F.greatest(F.lit(0.7), name["confidence"])))
            .otherwise(told(name["type"], "filename", name["confidence"]))
        )

    return _let(F.struct(filing_type(file_name, folder).alias("name"), header_type(header).alias("top")), of)


def title_case(text: Column) -> Column:
    """Each word with a capital, but for small words after the first."""
    words = F.split(text, r"\s+")
    word = lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
    return F.array_join(F.transform(words, word), " ")


def _no_shouting(text: Column) -> Column:
    return F.when(text == F.upper(text), title_case(text)).otherwise(text)


def header_title(header: Column) -> Column:
    """The first of the top twenty lines, of 5 to 150 characters and beyond the preamble, that names a type; null without one."""
    lines = F.slice(F.filter(F.transform(F.split(F.substring(header, 1, 1500), "\n"), F.trim), lambda x: x != ""), 1, 20)
    names = "|".join(p for _, _, p in _named_types())
    clean = lambda x: F.trim(F.regexp_replace(x, r"^[:\-–—\s]+|[:\-–—\s]+$", ""))
    good = lambda x: F.length(x).between(5, 150) & ~_has(x, "(?:" + "|".join(PREAMBLE) + ")") & _has(x, f"(?:{names})") & F.length(clean(x)).between(8, 150)
    return _let(clean(F.get(F.filter(lines, good), F.lit(0))), _no_shouting)


def filing_title(file_name: Column, header: Column | None = None, folder: Column | None = None) -> Column:
    """The name without case numbers, dates, versions and states; the folder's or the text's title where only numbers
    are left; the text's where it is half as long again and under 200 characters."""
    tidy = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "[-_]", " "), r"\s+", " "))
    numbers = lambda t: F.regexp_like(F.regexp_replace(t, r"[-_.\s]", ""), F.lit(r"^\d+$"))
    raw = spaced_words(base_name(F.coalesce(file_name, F.lit(""))))
    none = F.lit(None).cast("string")
    top = none if header is None else header_title(header)
    from_folder = none if folder is None else _let(folder, lambda t: F.when((F.length(t) >= 3) & ~numbers(t), tidy(t)))

    def short(x: Column) -> Column:
        bare = numbers(x["stripped"]) | (F.length(x["stripped"]) < 3)
        own = F.when(F.length(x["stripped"]) < 3, tidy(x["raw"])).otherwise(x["stripped"])
        return F.when(bare, F.coalesce(x["folder"], x["top"], own)).otherwise(own)

    calm = lambda t: F.when((t == F.upper(t)) & (F.length(t) > 3), title_case(t)).otherwise(t)

    def longest(x: Column) -> Column:
        told = _let(short(x), calm)
        return _let(told, lambda t: F.when((F.length(x["top"]) > 1.5 * F.length(t)) & (F.length(x["top"]) < 200), x["top"]).when(t == "", x["raw"]).otherwise(t))

    parts = lambda r: F.struct(r.alias("raw"), tidy(_without(r, *STRIPPED)).alias("stripped"), from_folder.alias("folder"), top.alias("top"))
    return _let(_let(raw, parts), longest)
