"""Export of Markdown: sections as slides have them, and plain HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_BOLD = re.compile(r"\*\*(.+?)\*\*")
_BOLD_LINE = re.compile(r"\*\*[^*]+\*\*:?\s*")
SECTION = ArrayType(StructType([StructField("title", StringType()), StructField("subtitle", StringType()), StructField("bullets", ArrayType(StringType())), StructField("is_title", BooleanType())]))


def _sections(text, title):
    """Sections of one text: heads and bold lines open one, the rest become bullets, the first line below a title its subtitle."""
    out = []

    def opened(name, is_title=False):
        out.append({"title": name, "subtitle": "", "bullets": [], "is_title": is_title})

    for line in map(str.rstrip, (text or "").splitlines()):
        head = re.match(r"(#{1,3}) (.*)", line)
        bullet = line.startswith(("- ", "• "))
        if not line:
            continue
        if head and len(head[1]) < 3:
            opened(head[2].strip(), len(head[1]) == 1)
        elif _BOLD_LINE.fullmatch(line):
            opened(line.strip("* :").strip())
        else:
            value = "  " + head[2].strip() if head else _BOLD.sub(r"\1", line[2:].strip() if bullet else line)
            value = value if head or bullet else value.strip()
            if not value and not bullet:
                continue
            if not out:
                opened("Summary" if head else title or "Summary")
            last = out[-1]
            if not head and not bullet and last["is_title"] and not last["subtitle"]:
                last["subtitle"] = value
            else:
                last["bullets"].append(value)
    return out or [{"title": title or "Summary", "subtitle": "", "bullets": [], "is_title": False}]


@F.pandas_udf(SECTION)
def sections(text: pd.Series, title: pd.Series) -> pd.Series:
    """Sections of each text, in Arrow batches: what a line becomes depends on the lines before it."""
    return pd.Series([_sections(t, h) for t, h in zip(text, title)])


def html(parsed):
    """HTML of a column of sections."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), safe(x), F.lit(f"</{name}>"))

    def one(s):
        items = F.when(F.size(s["bullets"]) > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(s["bullets"], lambda b: tag("li", F.trim(b))), ""), F.lit("</ul>"))).otherwise("")
        return F.concat(F.when(s["is_title"], tag("h1", s["title"])).otherwise(tag("h2", s["title"])), F.when(s["subtitle"] != "", tag("p", s["subtitle"])).otherwise(""), items)

    return F.array_join(F.transform(parsed, one), "\n")
