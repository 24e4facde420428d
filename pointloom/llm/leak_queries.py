"""Documents that hold passages of the held-out items (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.leaks import find_leaks, remove_leaks
from pointloom.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark_items"), "item_id", "text"


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items of which they have ten words in a row."""
    return find_leaks(*_tables(spark, folder)).select("doc_id", "item_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item and document, how much of it was found and where."""
    return find_leaks(*_tables(spark, folder))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the leaked passages cut out."""
    return remove_leaks(*_tables(spark, folder))


def _plain_sql(text: str) -> str:
    """SQL for a text's comparable form; compatibility forms are those of ASCII and the Latin ligatures, which is what the tables hold."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
    ascii_ = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    inline = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
    x = f"regexp_replace({text}, '</?(?:{inline})(?:\\s[^<>]*)?/?>', '', 'gi')"
    x = f"regexp_replace({x}, '<(?:/?[a-zA-Z][a-zA-Z0-9-]*(?:\\s[^<>]*)?/?|!--.*?--|![a-zA-Z][^<>]*)>', ' ', 'gs')"
    for entity, shown in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{shown}')"
    x = f"regexp_replace({x}, '!?\\[([^\\[\\]\\n]*)\\]\\([^()\\s]*\\)', '\\1', 'g')"
    x = f"regexp_replace({x}, '[\\p{{Cf}}\\x{{034F}}\\x{{FE00}}-\\x{{FE0F}}\\x00-\\x08\\x0e-\\x1b\\x7f]', '', 'g')"
    x = f"lower(translate({x}, '{wide}', '{ascii_}'))"
    for joined, parts in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
        x = f"replace({x}, '{joined}', '{parts}')"
    return f"nfc_normalize({x})"


def _grams_sql(table: str, name: str) -> str:
    held = f"SELECT {name} AS id, regexp_extract_all({_plain_sql('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT id, array_to_string(w[i:i + 9], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM ({held}) WHERE len(w) >= 10)"


SQL = {
    "p7_found": f"WITH d AS ({_grams_sql('documents', 'doc_id')}), b AS ({_grams_sql('benchmark_items', 'item_id')}) SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM d JOIN b ON d.gram = b.gram",
}
QUERIES = {"p7_found": p7_found, "p7_report": p7_report, "p7_clean": p7_clean}
