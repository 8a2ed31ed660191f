"""Column helpers: times, addresses' direction, flag bits, CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the header's second word (RFC 1035, RFC 4035).
BITS = {"qr": 15, "aa": 10, "tc": 9, "rd": 8, "ra": 7, "z": 6, "ad": 5, "cd": 4}


def flag(word: Column, name: str) -> Column:
    return F.shiftright(word, BITS[name]).bitwiseAND(1) == 1


def opcode(word: Column) -> Column:
    return F.shiftright(word, 11).bitwiseAND(15)


def rcode(word: Column) -> Column:
    return word.bitwiseAND(15)


def header_word(message: Column, at: int) -> Column:
    """Two bytes of a DNS message (``at`` from 0) as a number; null past its end."""
    return F.when(F.octet_length(message) >= at + 2, F.conv(F.hex(F.substring(message, at + 1, 2)), 16, 10).cast("int"))


def seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def micros(fsec: Column) -> Column:
    """Whole microseconds of fractional seconds, cut off."""
    return (fsec * F.lit(1e6)).cast("long")


def from_timespec(sec: Column, nsec: Column) -> Column:
    return sec.cast("long") * 1_000_000 + F.floor(nsec / 1000)


def time_text(us: Column) -> Column:
    """Seconds with six decimals, exact."""
    return F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


#: strftime directives and date patterns for the same text.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%p": "a", "%I": "hh", "%%": "'%'",
}


def strftime(us: Column, pattern: str) -> Column:
    """UTC text of a time (session time zone UTC) for a strftime pattern."""
    out, i, plain = [], 0, ""
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "%s":
            raise ValueError("%s has no date pattern")
        if two in STRFTIME:
            out += [f"'{plain}'"] if plain else []
            out.append(STRFTIME[two])
            plain, i = "", i + 2
        else:
            plain += "''" if pattern[i] == "'" else pattern[i]
            i += 1
    out += [f"'{plain}'"] if plain else []
    return F.date_format(F.timestamp_micros(us), "".join(out))


def rotation_due(last: Column, now: Column, period_sec: int) -> Column:
    """A file opened at ``last`` is closed at ``now``: strictly more than the period later."""
    return last < now - F.lit(period_sec * 1_000_000)


def rotation_start(us: Column, period_sec: int) -> Column:
    """Start of the aligned output period (microseconds)."""
    p = period_sec * 1_000_000
    return us - F.pmod(us, F.lit(p))


def qname_matches(request: Column, response: Column) -> Column:
    """A response's root name stands for any; two missing names are equal."""
    return (response == ".") | request.eqNullSafe(response)


def escape(text: Column, separator: str) -> Column:
    """CSV text of free strings: backslash first, then NUL, line feed and the separator."""
    graphic = separator.isprintable() and not separator.isspace()
    mark = "\\" + (separator if graphic else f"{ord(separator):03o}")
    for old, new in (("\\", "\\\\"), ("\0", "\\0"), ("\n", "\\n"), (separator, mark)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def guard(text: Column, separator: str) -> Column:
    """Names come escaped already: only what would break the line is replaced."""
    graphic = separator.isprintable() and not separator.isspace()
    mark = "\\" + (separator if graphic else f"{ord(separator):03o}")
    for old, new in (("\0", "\\0"), ("\n", "\\n"), (separator, mark)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def number_list(values: Column, separator: str) -> Column:
    """Comma-joined numbers; the commas are escaped where they separate columns too."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), "\\," if separator == "," else ",")


def directed(packets: DataFrame) -> DataFrame:
    """Client and server side: a request's source, a response's destination is the client."""
    r = F.col("is_response")
    return packets.withColumns({
        f"{side}_{what}": F.when(r, F.col(f"{a}_{what}")).otherwise(F.col(f"{b}_{what}"))
        for side, a, b in (("client", "dst", "src"), ("server", "src", "dst")) for what in ("addr", "port")
    })


def normal_name(qname: Column) -> Column:
    """Lower case, without the final dot; the root is empty."""
    return F.regexp_replace(F.lower(qname), r"\.$", "")


def label_count(qname: Column) -> Column:
    plain = normal_name(qname)
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"\."))).cast("int")


def domain_name(qname: Column) -> Column:
    """Last two labels."""
    return F.substring_index(F.regexp_replace(qname, r"\.$", ""), ".", -2)
