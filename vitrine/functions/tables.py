"""Table functions callable from SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_ANCHOR = re.compile(r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


@udtf(returnType="pos int, href string, text string")
class HtmlLinks:
    """``SELECT … FROM pages, LATERAL html_links(html)``."""

    def eval(self, html: str):
        for pos, m in enumerate(_ANCHOR.finditer(html or "")):
            yield pos, m.group(1), _TAG.sub("", m.group(2)).strip()


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_links", HtmlLinks)
