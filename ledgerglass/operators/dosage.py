"""Dosage passages, quoted word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heads of dosage passages, doses, frequencies, signs of earlier treatment, pointers, groups of patients.
DOSE_HEAD = r"(?U)^\s*[（(]?[\dA-Za-z一二三四五六七八九十ⅠⅡⅢⅣⅤ]+\s*[.)）、]?\s*(使用劑量|劑量給予方式|用法用量|給藥方式|使用方式|劑量及用法|劑量)\s*[：:]"
DOSE_VALUE = r"(?iU)\d[\d.,\-–~至]*\s*(mg|ｍｇ|毫克|公絲|mcg|微克|g\b|gm|公克|ml|毫升|IU|單位|%|﹪)(\s*/\s*(kg|公斤|m2|平方公尺|day|日|天|次|週|月))?"
FREQUENCY = r"(?U)每\s*\d*\s*(週|周|星期|日|天|月|次|小時|療程|人|指|趾)|隔\s*\d*\s*(週|日|天)|起始劑量|維持劑量|首劑|一次|一療程|總劑量|限用|不超過|不高於"
PREREQUISITE = r"曾(經)?接受|治療無效|反應不佳|無法耐受|禁忌|先前|已使用|充分治療|標準療法|傳統(全身性)?治療|至少.{0,8}(週|個月|月)"
POINTER = r"(詳見|參見|請詳閱|詳如|見|依|遵)\s*[^。]{0,8}(仿單|說明書|附件|包裝插頁|外盒|標籤|擬稿)|遵醫師指示|依醫師處方|請洽醫師"
ADJUST = r"(?i)腎功能|腎臟|腎不全|腎損|肌酸酐|creatinine|CrCl|GFR|透析|洗腎|肝功能|肝硬化|肝臟|肝損|Child-?Pugh|老年|高齡|年長|兒童|小兒|嬰兒|新生兒|青少年|孕婦|懷孕|哺乳|授乳|體重|kg"
SENTENCE = r"[^。；;\n]+[。；;\n]?"


def is_substantive(text: Column, pointer: str = POINTER, least: int = 10) -> Column:
    """Whether `least` characters are left without pointers to other papers, brackets and punctuation."""
    body = F.regexp_replace(F.regexp_replace(text, pointer, ""), r"[（(][^）)]*[）)]", "")
    return F.length(F.regexp_replace(body, r"(?U)[\s。、，,.；;]", "")) >= least


def adjust_quotes(text: Column, adjust: str = ADJUST, sentence: str = SENTENCE, least: int = 6) -> Column:
    """Sentences of at least `least` characters that name a group of patients; none if the text is nothing but one of them."""
    edge = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    all_of = F.transform(F.regexp_extract_all(text, F.lit(sentence), 0), edge)
    hit = F.filter(all_of, lambda s: (F.length(s) >= least) & s.rlike(adjust))
    bare = lambda x: F.regexp_replace(edge(x), "[。；;]+$", "")
    alone = (F.size(hit) == 1) & (bare(F.try_element_at(hit, F.lit(1))) == bare(text))
    return F.when(alone, F.array().cast("array<string>")).otherwise(hit)


def dosage_blocks(clauses: DataFrame, key: str, head: Column) -> DataFrame:
    """`clauses` (key, idx, level, …) with `block`: the idx of the dosage head that a clause belongs to.

    A block is its head and the deeper clauses after it; one fold over a text's
    levels, as whether a head begins a block depends on the block before.
    """
    g = clauses.withColumn("__h", head).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "level", F.col("__h").alias("head")))).alias("c"))
    start = F.struct(F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("level"), F.array().cast("array<struct<idx:int,block:int>>").alias("out"))

    def step(s, x):
        inside = s["block"].isNotNull() & (x["level"] > s["level"])
        block = F.when(inside, s["block"]).when(x["head"], x["idx"])
        level = F.when(inside, s["level"]).when(x["head"], x["level"])
        return F.struct(block.alias("block"), level.alias("level"), F.array_append(s["out"], F.struct(x["idx"].alias("idx"), block.alias("block"))).alias("out"))

    marked = g.select(key, F.inline(F.aggregate("c", start, step, lambda s: s["out"])))
    return clauses.join(marked, [key, "idx"])


def collect_dosage(clauses: DataFrame, listed: DataFrame, clause_mentions: DataFrame) -> DataFrame:
    """clauses (code, idx, level, text), listed (inn, code), clause_mentions (code, idx, inn) -> inn, code, idx, class, quote, for_drugs.

    direct: inside a dosage block, the clause names the drug and no other;
    section_sole: it names none, or gives a dose with a frequency, in a section that is about this drug alone;
    prerequisite: it names others and speaks of earlier treatment, in a block or with a dose.
    A quote comes once in each class.
    """
    blocks = dosage_blocks(clauses, "code", F.substring_index("text", "\n", 1).rlike(DOSE_HEAD))
    per_section = clause_mentions.groupBy("code").agg(F.collect_set("inn").alias("sec_inns"))
    per_clause = clause_mentions.groupBy("code", "idx").agg(F.collect_set("inn").alias("inns"))
    empty = F.array().cast("array<string>")
    rows = listed.join(blocks, "code").join(per_section, "code", "left").join(per_clause, ["code", "idx"], "left").withColumn("inns", F.coalesce("inns", empty)).withColumn("sec_inns", F.coalesce("sec_inns", empty))
    others = F.array_sort(F.array_except("inns", F.array("inn")))
    rows = rows.withColumn("others", others).withColumn("mine", F.array_contains("inns", F.col("inn"))).withColumn("sole", (F.size("sec_inns") == 1) & F.array_contains("sec_inns", F.col("inn")))
    text, in_block, none = F.col("text"), F.col("block").isNotNull(), F.size("others") == 0
    prerequisite = ~none & text.rlike(PREREQUISITE) & (in_block | text.rlike(DOSE_VALUE))
    kinds = F.array_compact(
        F.array(
            F.when(in_block & F.col("mine") & none, "direct"),
            F.when(F.col("sole") & none & ((in_block & ~F.col("mine")) | (text.rlike(DOSE_VALUE) & text.rlike(FREQUENCY) & ~(in_block & F.col("mine")))), "section_sole"),
            F.when(prerequisite, "prerequisite"),
        )
    )
    found = rows.withColumn("class", F.explode(kinds))
    first = F.row_number().over(Window.partitionBy("inn", "class", "text").orderBy("code", "idx"))
    return found.withColumn("nth", first).where("nth = 1").select("inn", "code", "idx", "class", F.col("text").alias("quote"), F.when(F.col("class") == "prerequisite", F.col("others")).alias("for_drugs"))


def label_dosage(products: DataFrame, k: int = 6) -> DataFrame:
    """products (inn, text, licence_no, brand, ordinal) -> one row per ingredient and text: first k licences and brands in order, sentences to adjust, number of products.

    Licences and brands are made distinct by partial aggregates and ranked before
    anything is collected, so that a text of any number of products brings 2 k values.
    """
    rows = products.where(is_substantive(F.col("text")))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("licence_no", "brand"))))
    seen = rows.select("inn", "text", "ordinal", each.alias("x")).groupBy("inn", "text", "x.kind", "x.value").agg(F.min("ordinal").alias("seen"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("inn", "text", "kind").orderBy("seen"))
    ranked = seen.withColumn("place", place)
    first = lambda c: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == c) & (F.col("place") <= k), F.struct("place", "value")))), lambda r: r["value"])
    g = ranked.groupBy("inn", "text").agg(first("licence_no").alias("licences"), first("brand").alias("brands"), F.sum(F.when(F.col("kind") == "brand", F.col("n"))).alias("n_products"))
    return g.withColumn("adjust", adjust_quotes(F.col("text")))
