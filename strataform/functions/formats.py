r"""Named string formats as Java expressions. Each is anchored with ``\A`` and ``\z``: Java's ``$`` matches before a final newline."""

from __future__ import annotations

import re

#: What the formats are made of.
HEX = "[0-9a-fA-F]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
H4 = f"{HEX}{{1,4}}"
#: What JavaScript calls white space, as members of a class.
WHITE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: k groups before the gap leave up to 7 - k behind it.
IPV6 = "(?:" + "|".join([f"(?:{H4}:){{7}}{H4}", f"(?:{H4}:){{1,7}}:"] + [f"(?:{H4}:){{1,{7 - k}}}(?::{H4}){{1,{k}}}" for k in range(1, 7)] + [f":(?:(?::{H4}){{1,7}}|:)"]) + ")"
DAY = r"(?:(?:\d\d[2468][048]|\d\d[13579][26]|\d\d0[48]|[02468][048]00|[13579][26]00)-02-29|\d{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8])))"


#: A clock's parts, by definition of ISO 8601; what follows the minutes depends on the precision asked for.
CLOCK = {"hour": r"(?:[01]\d|2[0-3])", "minute": r"[0-5]\d", "second": r"[0-5]\d"}
MINUTES = f"{CLOCK['hour']}:{CLOCK['minute']}"
SECONDS = {None: rf"(?::{CLOCK['second']}(?:\.\d+)?)?", -1: "", 0: f":{CLOCK['second']}"}
#: Zones by what allows them.
ZONES = {"always": "Z", "local": "", "offset": f"[+-]{MINUTES}"}
#: Digits of a UUID's groups, and the two that have no version.
UUID_GROUPS = (8, 4, 4, 4, 12)
UUID_ENDS = ("0", "f")


def time_source(precision: int | None = None) -> str:
    return MINUTES + SECONDS.get(precision, rf":{CLOCK['second']}\.\d{{{precision}}}")


def datetime_source(offset: bool = False, local: bool = False, precision: int | None = None) -> str:
    allowed = [zone for name, zone in ZONES.items() if {"always": True, "local": local, "offset": offset}[name]]
    return f"{DAY}T{time_source(precision)}(?:{'|'.join(allowed)})"


def uuid_source(version: int | None = None) -> str:
    """Groups of digits; the third begins with the version, the fourth with the variant."""
    first = {2: str(version or "[1-8]"), 3: "[89abAB]"}
    own = "-".join(f"{first[k]}{HEX}{{{n - 1}}}" if k in first else f"{HEX}{{{n}}}" for k, n in enumerate(UUID_GROUPS))
    ends = ["-".join(digit * n for n in UUID_GROUPS) for digit in UUID_ENDS if not version]
    return "(?:" + "|".join([own, *ends]) + ")"


def mac_source(delimiter: str = ":") -> str:
    """Six pairs of digits, all in one case."""
    return "(?:" + "|".join(re.escape(delimiter).join([f"[{digits}]{{2}}"] * 6) for digits in ("0-9A-F", "0-9a-f")) + ")"


#: Bytes of each digest.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}


def digest_source(algorithm: str, encoding: str = "hex") -> str:
    n = DIGESTS[algorithm]
    if encoding == "hex":
        return f"{HEX}{{{2 * n}}}"
    body = -(-n * 4 // 3)
    return f"[A-Za-z0-9_-]{{{body}}}" if encoding == "base64url" else f"[A-Za-z0-9+/]{{{body}}}{'=' * (-body % 4)}"


#: The formats' own expressions.
FORMATS = {
    "email": r"(?!\.)(?!.*\.\.)[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "html5_email": rf"[a-zA-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{LABEL}(?:\.{LABEL})*",
    "rfc5322_email": rf"(?:[^<>()\[\]\\.,;:{WHITE}@\"]+(?:\.[^<>()\[\]\\.,;:{WHITE}@\"]+)*|\".+\")@(?:\[[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\]|(?:[a-zA-Z\-0-9]+\.)+[a-zA-Z]{{2,}})",
    "unicode_email": rf"[^{WHITE}@\"]{{1,64}}@[^{WHITE}@]{{1,255}}",
    "guid": f"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}",
    "cuid": "[cC][0-9a-z]{6,}",
    "cuid2": "[0-9a-z]+",
    "ulid": "[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{26}",
    "xid": "[0-9a-vA-V]{20}",
    "ksuid": "[A-Za-z0-9]{27}",
    "nanoid": "[a-zA-Z0-9_-]{21}",
    "jwt": r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "duration": r"P(?:\d+W|(?!.*W)(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:[.,]\d+)?S)?)?)",
    "extended_duration": "[-+]?P(?!\\z)" + "".join(rf"(?:[-+]?\d+{u}|[-+]?\d+[.,]\d+{u}\z)?" for u in "YMWD") + r"(?:T(?=[\d+-])" + "".join(rf"(?:[-+]?\d+{u}|[-+]?\d+[.,]\d+{u}\z)?" for u in "HM") + r"(?:[-+]?\d+(?:[.,]\d+)?S)?)?",
    "ipv4": IPV4,
    "ipv6": IPV6,
    "cidrv4": rf"{IPV4}/(?:[0-9]|[1-2][0-9]|3[0-2])",
    "cidrv6": rf"{IPV6}/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])",
    "base64": "(?:[0-9a-zA-Z+/]{4})*(?:[0-9a-zA-Z+/]{2}==|[0-9a-zA-Z+/]{3}=)?",
    "base64url": "[A-Za-z0-9_-]*",
    "hex": f"{HEX}*",
    "hostname": rf"(?=.{{1,253}}\.?\z){LABEL}(?:\.{LABEL})*\.?",
    "domain": rf"(?:{LABEL}\.)+[a-zA-Z]{{2,}}",
    "e164": r"\+[1-9]\d{6,14}",
    "iso_date": DAY,
    "bigint_text": r"-?\d+n?",
    "integer_text": r"-?\d+",
    "number_text": r"-?\d+(?:\.\d+)?",
    "boolean_text": "(?i:true|false)",
    "lowercase_text": "[^A-Z]*",
    "uppercase_text": "[^a-z]*",
    "http_protocol": "https?:?",
    "http_url": rf"(?i:https?)://[^{WHITE}/?#]+[^{WHITE}]*",
    #: Java has no Extended_Pictographic; these ranges hold it and the components.
    "emoji": r"[\x{23}\x{2a}0-9\x{a9}\x{ae}\x{200d}\x{203c}\x{2049}\x{20e3}\x{2122}\x{2139}\x{2194}-\x{21aa}\x{231a}-\x{23ff}\x{24c2}\x{25aa}-\x{27bf}\x{2934}\x{2935}\x{2b05}-\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{fe0f}\x{1f000}-\x{1faff}\x{e0020}-\x{e007f}]+",
}
FORMATS["url"] = rf"(?i:https?|ftp|wss?)://[^{WHITE}/?#]+[^{WHITE}]*|(?i:(?!(?:https?|ftp|wss?):)[a-z][a-z0-9+.-]*):[^{WHITE}]*"


def anchored(source: str) -> str:
    return rf"\A(?:{source})\z"


def from_javascript(source: str) -> str:
    r"""A JavaScript expression for Java: every anchor, ``.`` and ``\s``, in classes and outside, means there what it meant."""
    out, inside, k = [], False, 0
    while k < len(source):
        c = source[k]
        if c == "\\":
            pair = source[k : k + 2]
            out.append({r"\s": WHITE, r"\S": f"[^{WHITE}]"}[pair] if pair in (r"\s", r"\S") and inside else {r"\s": f"[{WHITE}]", r"\S": f"[^{WHITE}]"}.get(pair, pair))
            k += 2
            continue
        if inside:
            out.append({"[": r"\[", "&": r"\&"}.get(c, c))
            inside = c != "]"
        elif c == "[":
            inside = True
            begin = re.match(r"\[\^?", source[k:])[0]
            if source[k + len(begin) :].startswith("]"):  # [] is nothing, [^] anything
                out.append(r"(?!)" if begin == "[" else r"(?s:.)")
                inside, k = False, k + 1
            else:
                out.append(begin)
            k += len(begin) - 1
        else:
            out.append({"^": r"\A", "$": r"\z", ".": r"[^\n\r\x{2028}\x{2029}]"}.get(c, c))
        k += 1
    return "".join(out)


#: Checks with arguments of their own, besides the formats.
CHECKS = set(FORMATS) | {
    "starts_with", "ends_with", "includes", "regex", "string_format", "uuid", "mac", "time", "datetime", "iso_time", "digest", "digits_length", "no_empty", "trim", "normalize", "lowercase", "uppercase", "sanitize", "format", "cpf", "cnpj", "phone_br", "pii",
    "finite", "safe", "int32", "float32", "float64", "step", "days_of_week", "months_of_year", "truncate_to",
}


def source_of(name: str, args: tuple, kwargs: dict) -> str | None:
    """The expression of a format check, or None."""
    if name in FORMATS:
        return anchored(FORMATS[name])
    made = {"uuid": uuid_source, "mac": mac_source, "time": time_source, "iso_time": time_source, "datetime": datetime_source, "digest": digest_source}.get(name)
    return anchored(made(*args, **kwargs)) if made else None
