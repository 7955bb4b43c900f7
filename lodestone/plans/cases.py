"""Small record sets, held as literals, that reach every branch of the record operators; the same rows for both engines.

The driver's tables have no courses, outlines, headings or typographic variants, so queries over them alone would leave
statuses, families and marker levels unreached. Every frame here is used by ``lodestone.plans.records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"long": "bigint", "string": "varchar", "double": "double", "boolean": "boolean", "array<string>": "varchar[]", "array<double>": "double[]"}

CASES: dict[str, tuple[str, list[tuple]]] = {
    "outlines": (
        "item_id long, subject string, types array<string>, core array<string>, outline array<string>, remarks string, source string, page long, vector array<double>",
        [
            (1, "資料結構", ["技術類"], ["陣列與串列", "樹狀結構"], ["堆疊、佇列", "二元樹走訪；圖形演算法"], "含演算法分析", "a.pdf", 3, [0.8, 0.1, 0.1, 0.5]),
            (2, "資料結構", ["行政類"], ["串列", "雜湊表"], ["排序與搜尋"], None, "b.pdf", 7, [0.7, 0.2, 0.0, 0.4]),
            (3, "行政法", ["行政類"], ["行政處分", "依法行政原則"], ["行政程序法", "行政救濟與國家賠償"], "最新法規為準", "c.pdf", 1, [0.0, 0.9, 0.1, 0.1]),
            (4, "Ｃ＋＋程式設計", ["技術類", "特考"], ["類別與物件", "樣板"], ["pointers and references; templates"], "", "d.pdf", 12, [0.5, 0.0, 0.8, 0.2]),
            (5, "計算機概論", ["技術類", "行政類"], ["作業系統", "計算機架構"], ["網路概論", "資料庫概論"], "ﬁle systems ① 至 ③", "e.pdf", 4, [0.6, 0.3, 0.4, 0.3]),
            (6, "Straße und Brücke", [], ["Brücken \"bauen\""], [], None, None, None, [0.1, 0.1, 0.2, 0.9]),
            (7, "微積分", None, None, None, None, "g.pdf", 9, [0.2, 0.2, 0.2, 0.2]),
            (8, "機率與統計學", ["技術類"], ["機率分布"], ["估計與檢定", "迴歸分析"], "可用計算器", "h.pdf", 2, [0.3, 0.1, 0.6, 0.6]),
        ],
    ),
    "courses": (
        "query_id long, title string, department string, semester string, degree string, flag string, raw_sha256 string, description string, outline string, objectives string, url string, status string",
        [
            (1, "資料結構", "資訊工程學系", "上學期", "Bachelor", "TRUE", " AB12 ", "介紹陣列與串列、樹狀結構", "堆疊、佇列 二元樹走訪 排序與搜尋", "熟悉演算法分析", "https://a.example/1", "verified"),
            (2, "行政法", "法律學系", "第二學期", "碩士", "false", "", "依法行政原則與行政處分", "行政程序法 行政救濟與國家賠償", "", "https://a.example/2", "mismatch"),
            (3, "計算機概論導論", "電機系", "1", "master", "yes", None, "作業系統與計算機架構", None, "了解網路概論", "", None),
            (4, "C++ 程式設計", "資工系", " 下學期 ", "Undergraduate Program", None, "CD34", "pointers and templates", "類別與物件", "", None, "verified"),
            (5, "Gardening", None, "summer", None, "False", "cd34", "plants and seasons", "", None, "http://a.example/5", ""),
            (6, "", "", "", "", "", "", "", "", "", "", ""),
            (7, "strasse UND brücke", "土木系", "First Semester", "學士", "true", "ef56", "Brücken bauen", "Straßen　planen", "build", "https://a.example/7", "verified"),
            (8, "微積分（一）", "行政管理系", "下半年", "bachelor", "0", "ab12", "極限與連續", "微分", "積分", "https://a.example/8", "pending"),
        ],
    ),
    "candidates": (
        "query_id long, item_id long, score double",
        [(1, 1, 0.91), (1, 2, 0.90), (1, 5, 0.30), (2, 3, 0.88), (2, 5, 0.2), (3, 5, 0.61), (3, 1, 0.60), (3, 8, 0.1), (4, 4, 0.7), (4, 1, 0.12), (5, 8, 0.05), (7, 6, 0.8), (8, 7, 0.4), (8, 2, 0.39)],
    ),
    "chunks": (
        "query_id long, chunk_no long, section string, text string, vector array<double>",
        [
            (1, 0, "course_description", "介紹陣列與串列、樹狀結構", [0.9, 0.0, 0.1, 0.3]), (1, 1, "outline", "堆疊、佇列 二元樹走訪 排序與搜尋", [0.6, 0.1, 0.1, 0.6]), (1, 2, "outline", "作業與考試 office hour", [0.1, 0.1, 0.1, 0.1]),
            (2, 0, "course_description", "依法行政原則與行政處分", [0.0, 1.0, 0.0, 0.1]), (2, 1, "outline", "行政程序法 行政救濟與國家賠償", [0.1, 0.8, 0.1, 0.0]),
            (3, 0, "course_description", "作業系統與計算機架構", [0.5, 0.2, 0.4, 0.4]), (3, 1, "objectives", "了解網路概論", [0.5, 0.2, 0.4, 0.4]),
            (4, 0, "course_description", "pointers and templates", [0.4, -0.2, 0.9, 0.1]), (5, 0, "course_description", "plants and seasons", [-0.3, -0.2, -0.1, 0.0]),
            (7, 0, "course_description", "Brücken bauen", [0.1, 0.0, 0.1, 0.9]), (8, 0, "course_description", "極限與連續", [0.2, 0.1, 0.3, 0.2]),
        ],
    ),
    "lines": (
        "doc_id long, text string",
        [
            (1, "第一章 導論\n什麼是演算法；為什麼要分析\n第一節 漸近符號\nBig-O 定義。Omega 定義！\n1.1 遞迴\n1.1.1 主定理\n2) 排序\n快速排序"),
            (2, "第二章 樹\n第一節 二元樹\n走訪；走訪；走訪\n第三章 圖\n最短路徑\n二、最小生成樹\nKruskal"),
            (3, "期中考試 30%\n教材：教科書第三版\noffice hour: 星期三\n課程進度 schedule\n講授 討論 實作\n真正的內容"),
            (4, "1. alpha beta\n2.1 gamma delta\n- bullet item one\n* bullet item two\nplain line"),
            (5, ""), (6, None), (7, "ab\n\r\n  \n" + "長" * 301),
        ],
    ),
    "observed": (
        "field string, type string",
        [("candidate_match", "bool"), ("candidate_match", "str"), ("alias", "dict"), ("alias", "str"), ("alias", "null"), ("title", "str"), ("title", "null"), ("empty", "null")],
    ),
    "blobs": (
        "rec long, blob string, outline string",
        [(1, "課程目標：學會排序 課程大綱：堆疊與佇列 授課進度：第一週 緒論", "不用"), (2, "課程目標：只有目標", "後備大綱"), (3, "", ""), (4, None, "僅後備")],
    ),
    "artifacts": (
        "artifact string, sha256 string",
        [("/data/a.html", "AA11"), ("/data/b.html", "bb22"), ("/data/c.html", "cc33"), (None, "dd44"), ("/data/e.html", None)],
    ),
    "files": ("path string, sha256 string", [("file:/data/a.html", "aa11"), ("file:///data/b.html", "ffff"), ("/data/e.html", "ee55")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = CASES[name]
    return spark.createDataFrame(rows, schema)


def _literal(value, kind: str) -> str:
    if value is None:
        return f"null::{SQL_TYPES[kind]}"
    if isinstance(value, list):
        inner = SQL_TYPES[kind].removesuffix("[]")
        return f"[{', '.join(_literal(x, next(k for k, v in SQL_TYPES.items() if v == inner)) for x in value)}]::{SQL_TYPES[kind]}"
    if isinstance(value, str):
        text = value.replace("'", "''")
        return "('" + text.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "')"
    return f"{str(value).lower()}::{SQL_TYPES[kind]}"


def relation(name: str) -> str:
    """The same rows as an SQL relation."""
    schema, rows = CASES[name]
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_literal(x, kind) for x, (_, kind) in zip(row, fields)) + ")" for row in rows)
    return f"(select * from (values {values}) as t({', '.join(n for n, _ in fields)}))"
