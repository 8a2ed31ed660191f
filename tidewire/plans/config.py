"""Settings of a run and their rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from .schema import FIELDS

#: Unit suffixes of numbers.
UNITS = {"d": 86400, "h": 3600, "k": 10**3, "m": 10**6, "g": 10**9, "K": 2**10, "M": 2**20, "G": 2**30, "%": 0.01}


def number(text: str) -> float:
    """A number with an optional unit suffix."""
    m = re.fullmatch(r"\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*([dhkmgKMG%]?)\s*", text)
    if not m:
        raise ValueError(f"not a number: {text!r}")
    value = float(m[1]) * (UNITS[m[2]] if m[2] else 1)
    return int(value) if value == int(value) else value


@dataclass
class Config:
    max_frame_duration: float = 0.5
    max_frame_size: int = 262144
    max_queue_len: int = 8
    report_period: float = 60
    input_uri: str = ""
    input_filter: str = ""
    input_snaplen: int = -1
    input_promiscuous: int = 1
    dump_path_fmt: str = ""
    dump_period: int = 0
    dump_compress_level: int = 4
    dump_compress_type: str = "none"
    dump_rate_limit: float = 0
    match_window: float = 5.0
    match_qname: int = 0
    output_type: str = "csv"
    output_path_fmt: str = ""
    output_pipe_cmd: str = ""
    output_period: int = 0
    csv_separator: str = ","
    csv_inline_header: int = 1
    csv_external_header_path_fmt: str = ""
    csv_fields: list[str] = field(default_factory=lambda: list(FIELDS))
    cbor_fields: list[str] = field(default_factory=lambda: list(FIELDS))

    def check(self) -> Config:
        rules = (
            (self.max_frame_duration >= 0.001, "max_frame_duration is at least 0.001"),
            (self.max_queue_len >= 1, "max_queue_len is at least 1"),
            (0 <= self.dump_compress_level <= 9, "dump_compress_level is 0 to 9"),
            (self.dump_compress_type in ("none", "gzip", "bz2", "lzo", "xz"), "unknown dump_compress_type"),
            (self.match_window > 0, "match_window is positive"),
            (self.output_type in ("csv", "cbor"), "output_type is csv or cbor"),
            (valid_separator(self.csv_separator), "csv_separator is one character, not alphanumeric and none of .-#_\\/ or a line feed"),
            (self.output_type != "csv" or self.csv_fields, "csv_fields is empty"),
            (self.output_type != "cbor" or self.cbor_fields, "cbor_fields is empty"),
        )
        for good, says in rules:
            if not good:
                raise ValueError(says)
        return self

    @property
    def output_fields(self) -> list[str]:
        return self.csv_fields if self.output_type == "csv" else self.cbor_fields


def valid_separator(text: str) -> bool:
    return len(text) == 1 and not (text.isascii() and text.isalnum()) and text not in ".-#_\\/\n"


def parse(text: str) -> Config:
    """Settings from lines ``key value``. Field lists add to what is set; ``:reset`` empties them first."""
    config, kinds = Config(), {f.name: f.type for f in fields(Config)}
    for line in text.splitlines():
        line = line.split("#")[0].strip() if not re.match(r"\s*csv_separator", line) else line.strip()
        if not line or line.endswith("{") or line == "}":
            continue
        key, _, value = line.partition(" ")
        key, value = key.rstrip(":"), value.strip().strip("'\"")
        base = key.partition(":")[0]
        if base not in kinds:
            raise ValueError(f"unknown setting: {base}")
        if kinds[base].startswith("list"):
            if ":reset" in f"{key} {value}" or ":reset" in line:
                setattr(config, base, [])
                value = value.replace(":reset", "")
            now = getattr(config, base)
            now.extend(v for v in value.split() if v not in now)
        else:
            setattr(config, base, value if kinds[base] == "str" else type(getattr(config, base))(number(value)))
    return config.check()
