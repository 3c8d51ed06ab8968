"""What a receiving server's headers say."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The methods that count, and the property each is reported by.
METHODS = {"spf": "smtp.mailfrom", "dkim": "header.d", "dmarc": "header.from"}


def first_header(block: str, name: str) -> str | None:
    """The topmost header of a name, unfolded: the one that the last server wrote."""
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*(?:\r?\n[ \t].*)*)", block)
    return re.sub(r"\r?\n[ \t]+", " ", m[1]).strip() if m else None


def verdicts(value: str) -> str:
    """The results of an Authentication-Results value, with the domain each was given for, and who gave them; comments left out."""
    while (bare := re.sub(r"\([^()]*\)", "", value)) != value:
        value = bare
    server, *rest = [" ".join(x.split()) for x in value.split(";")]
    out = []
    for clause in rest:
        m = re.match(r"(\w+)=(\S+)(.*)", clause)
        if m and (of := METHODS.get(m[1].lower())):
            known = re.search(rf"(?i)(?:^|\s){re.escape(of)}=(\S+)", m[3])
            out.append(f"{m[1].lower()}={m[2].lower()}" + (f" ({of}={known[1]})" if known else ""))
    return "; ".join((out or ["no spf, dkim or dmarc result"]) + ([f"by {server}"] if server else []))


@F.pandas_udf(StringType())
def authentication(block: pd.Series) -> pd.Series:
    """The verdicts of each header block; null where it has none."""
    return block.map(lambda b: None if b is None or (v := first_header(b, "Authentication-Results")) is None else verdicts(v))
