"""Text normal forms and field-state rules as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as Python's str.strip()/split() sees it; Java's \s is narrower. Fixed values.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters; runs are written as ranges, as a pattern tests the members of a class one by one.
SPACE_CLASS = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Texts that say "this field is empty on the original". Fixed values.
BLANK_MARKERS = ("空", "空白", "未提供", "无", "—", "–", "-", "/", "\\")

# Bank display names and the one legal name they stand for. Fixed values.
BANK_ALIASES = {
    "工商银行": "中国工商银行",
    "农业银行": "中国农业银行",
    "建设银行": "中国建设银行",
    "交通银行": "交通银行",
    "邮政储蓄银行": "中国邮政储蓄银行",
    "民生银行": "中国民生银行",
    "光大银行": "中国光大银行",
    "招商银行": "招商银行",
    "中信银行": "中信银行",
    "浦发银行": "上海浦东发展银行",
    "上海浦东发展银行": "上海浦东发展银行",
    "兴业银行": "兴业银行",
    "平安银行": "平安银行",
    "华夏银行": "华夏银行",
    "广发银行": "广发银行",
    "中国银行": "中国银行",
    "深圳农商银行": "深圳农商银行",
    "深圳农村商业银行": "深圳农商银行",
    "深圳农村商业银行股份有限公司": "深圳农商银行",
}
BANK_CHANNELS = ("网上银行", "企业网上银行", "个人网上银行", "电子银行", "手机银行", "网络银行")
RURAL_CATEGORIES = ("农商银行", "农村商业银行", "农商行")
NOT_ISSUER_WORDS = ("开户", "付款", "收款", "银行行号", "账号", "户名", "对方", "对手", "代理", "清算")

# Characters no Unicode normal form changes once widths are folded, so Python can be skipped.
_STABLE = "^[\\x00-\\x7f\\u4e00-\\u9fff\\u3001\\u3002\\u3008-\\u3011]*$"
_STABLE_NFC = (
    "^[\\x00-\\u02ff\\u4e00-\\u9fff\\u3000-\\u3020\\u2010-\\u2027\\uff01-\\uff5e]*$"
)
# Texts already in normal form, recognised in one scan: words of such characters, single spaces.
_PLAIN = "[\\x21-\\x7e\\u4e00-\\u9fff]+"
_PLAIN_NAME = f"^(?:{_PLAIN}(?: {_PLAIN})*)?$"
_PLAIN_WORD = f"^(?:{_PLAIN})?$"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``c`` once and use it many times; the optimiser would inline a plain reference."""
    return F.element_at(F.transform(F.array(c), body), 1)


def table(words: Mapping[str, str]) -> Column:
    """A lookup table as one literal; the optimiser turns it into a constant map."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in words.items())), F.lit("\x02"), F.lit("\x01"))


def fold_width(c: Column, last: int = 0xFF5E) -> Column:
    """Full-width forms U+FF01..last and the ideographic space to their ASCII twins."""
    wide = "".join(map(chr, range(0xFF01, last + 1))) + "\u3000"
    thin = "".join(chr(cp - 0xFEE0) for cp in range(0xFF01, last + 1)) + " "
    return F.translate(c, wide, thin)


def strip(c: Column, extra: str = "") -> Column:
    return F.btrim(c, F.lit(SPACES + extra))


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one space; the ends lose theirs."""
    return strip(F.regexp_replace(c, SPACE_CLASS + "+", " "))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_CLASS + "+", "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition. Stable texts are sent to Python as NULL and kept as they are."""
    stable = c.rlike(_STABLE_NFC)
    return F.coalesce(_nfc(F.when(~stable, c)), c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda texts: [None if v is None else unicodedata.normalize("NFC", v) for v in texts], na_action="ignore")


def composed(df: DataFrame, columns: list[str], widths: bool = True) -> DataFrame:
    """``df`` with the columns composed, and width-folded, in rows where any text needs it.

    ``df`` is read twice: rows that need nothing never leave the JVM.
    """
    if not columns:
        return df
    unstable = F.lit(False)
    for c in columns:
        unstable = unstable | ~F.coalesce(F.col(c).rlike(_STABLE_NFC), F.lit(True))
    told = df.filter(unstable).withColumn("_nfc", _nfc_each(F.array(*[fold_width(F.col(c)) if widths else F.col(c) for c in columns])))
    told = told.withColumns({c: F.get("_nfc", F.lit(i)) for i, c in enumerate(columns)}).drop("_nfc")
    return df.filter(~unstable).unionByName(told)


def nfkc(c: Column) -> Column:
    folded = fold_width(c)
    stable = folded.rlike(_STABLE)
    return F.coalesce(_nfkc(F.when(~stable, c)), folded)


def compatible(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the column as :func:`nfkc` gives it.

    ``df`` is read twice: rows that need nothing never leave the JVM.
    """
    folded = fold_width(F.col(column))
    stable = F.coalesce(folded.rlike(_STABLE), F.lit(True))
    return df.filter(stable).withColumn(name, folded).unionByName(df.filter(~stable).withColumn(name, _nfkc(F.col(column))))


def norm_search(c: Column) -> Column:
    """Search form: widths folded up to U+FF60, zero-width spaces dropped, ends stripped."""
    def fold(t: Column) -> Column:
        # Folding looks every character up, and most texts hold none of these.
        folded = F.regexp_replace(fold_width(t, 0xFF60), "\u200b", "")
        return strip(F.when(t.rlike("[\u200b\u3000\uff01-\uff60]"), folded).otherwise(t))

    return let(c, fold)


def norm_name(c: Column, compose: bool = True) -> Column:
    """Name form: widths folded, NFC, spaces collapsed; deliberately not NFKC.

    ``compose=False`` leaves out the NFC step for text already composed on the way in.
    """
    folded = fold_width(c)
    return F.when(c.rlike(_PLAIN_NAME), c).otherwise(squeeze(nfc(folded) if compose else folded))


def norm_account(c: Column, compose: bool = True) -> Column:
    folded = fold_width(c)
    return F.when(c.rlike(_PLAIN_WORD), c).otherwise(no_space(nfc(folded) if compose else folded))


def norm_bank(c: Column, compose: bool = True) -> Column:
    return F.regexp_replace(F.lower(norm_name(c, compose)), "ß", "ss")


def norm_field(field: Column, c: Column) -> Column:
    """Field form: NFKC with spaces collapsed, or removed in an account number."""
    return spaced_field(field, nfkc(c))


def spaced_field(field: Column, text: Column) -> Column:
    """The last step of :func:`norm_field`, for a text that is in NFKC."""
    return F.when(field == "account", no_space(text)).otherwise(squeeze(text))


def full_account(c: Column) -> Column:
    """A complete account: letters and digits, at least one digit, no mask letter."""
    return F.coalesce(c.rlike("^(?=[^0-9]*[0-9])[A-WYZa-wyz0-9]{1,128}$"), F.lit(False))


def account_state(c: Column) -> Column:
    """State of a normalised account text."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "blank")
        .when(c.rlike("[*＊×xX]"), "ambiguous")
        .when(c.rlike("(?:尾号|末四位|后四位|后\\d+位)\\s*[：:]?\\s*\\d{2,8}$"), "ambiguous")
        .when(~c.rlike("\\d"), "ambiguous")
        .otherwise("present")
    )


def field_state(field: Column, c: Column) -> Column:
    """State of a normalised field text read at a known place."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "missing")
        .when(c.isin(*BLANK_MARKERS), "blank")
        .when(c.contains("\ufffd") | (F.length(c) > 4096), "ambiguous")
        .when((field == "name") & ~c.rlike("[\\p{L}\\p{N}]"), "ambiguous")
        .when((field == "account") & ~c.rlike("^[0-9]+$"), "ambiguous")
        .otherwise("present")
    )


def labelled_state(field: Column, c: Column) -> Column:
    """State of a normalised value found beside a label; masked accounts stay ambiguous."""
    return (
        F.when((c == "") | c.isin(*BLANK_MARKERS), "blank")
        .when(field == "account", account_state(c))
        .when((field == "name") & ~c.rlike("[\\p{L}\\p{N}]"), "ambiguous")
        .otherwise("present")
    )


def canonical_bank(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """One legal name per bank heading, NULL where the text is no bank heading."""
    names = table(BANK_ALIASES if aliases is None else aliases)

    def name(compact: Column) -> Column:
        barred = compact.isin(*BANK_CHANNELS) | compact.rlike("|".join(NOT_ISSUER_WORDS))
        shaped = compact.rlike("^[\\u4e00-\\u9fff]{2,18}(?:银行|农村信用合作联社|农村信用社)$")
        bare = F.regexp_replace(compact, "^中国", "")
        found = F.coalesce(F.element_at(names, compact), F.when(shaped, F.coalesce(F.element_at(names, bare), compact)))
        # Few texts have a name, so what bars one is asked last.
        return let(found, lambda n: F.when(n.isNotNull() & ~barred, n))

    return let(F.regexp_replace(c, f"[A-Za-z·.\\-{SPACES}]+", ""), name)


def rural_unspecified(a: Column, b: Column) -> Column:
    """One side names only the rural-bank category, so neither match nor mismatch is proven."""
    left, right = no_space(a), no_space(b)
    named = "^[\\u4e00-\\u9fff]{2,18}(?:农商银行|农村商业银行)(?:股份有限公司|有限责任公司)?$"
    left_bare, right_bare = left.isin(*RURAL_CATEGORIES), right.isin(*RURAL_CATEGORIES)
    return (left_bare & (right_bare | right.rlike(named))) | (right_bare & left.rlike(named))


def bank_key(c: Column, compose: bool = True) -> Column:
    name = norm_name(c, compose)
    return F.regexp_replace(F.lower(F.coalesce(canonical_bank(name), name)), "ß", "ss")


def is_marker_line(c: Column, word: str = "打印次数") -> Column:
    """A whole print-count line: the word, a colon, digits."""
    return no_space(c).rlike(f"^{word}[:：]\\p{{Nd}}+$")


def is_marker_label(c: Column, word: str = "打印次数") -> Column:
    return no_space(c).isin(word + ":", word + "：")


def is_marker_value(c: Column) -> Column:
    return no_space(c).rlike("^[0-9]+$")


# Document kinds and the names shown for them. Fixed values.
DOCUMENT_LABELS = {
    "ordinary": "普通回单",
    "other_special": "其他特殊单证",
    "loan_settlement_notice": "贷款清算通知书",
    "loan_interest_notice": "贷款利息到期通知书",
    "electronic_tax_payment": "电子缴税付款凭证",
    "bank_fee": "银行收费凭证",
    "deposit_interest": "存款结息凭证",
}
AUTOMATIC_TYPES = ("loan_interest_notice", "loan_settlement_notice", "electronic_tax_payment")


def effective_type(manual: Column, automatic: Column) -> Column:
    """A manual decision beats detection, for this slip only."""
    return F.coalesce(manual, F.when(automatic.isin(*AUTOMATIC_TYPES), automatic), F.lit("ordinary"))


def type_label(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("普通回单")).otherwise(
        F.coalesce(F.element_at(table(DOCUMENT_LABELS), c), c)
    )
