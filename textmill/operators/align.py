"""Helpfulness and harmlessness notes, critiques, revisions and preference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators.quality import is_harmful

# Ids, categories and texts of the principles.
PRINCIPLES = (
    ("helpful_honest_clear", "helpfulness", "Provide helpful, clear, and truthful guidance. If uncertain, say so and suggest safe ways to verify.", "قدّم إرشادًا مفيدًا وواضحًا وصادقًا. إذا كنت غير متأكد فاذكر ذلك واقترح طرقًا آمنة للتحقق."),
    ("respectful_non_toxic", "harmlessness", "Avoid harassment, hate, abuse, and demeaning language. Maintain respectful tone in both English and Arabic.", "تجنب التحرش وخطاب الكراهية والإساءة واللغة المهينة. حافظ على نبرة محترمة بالعربية والإنجليزية."),
    ("no_illegal_harm", "harmlessness", "Do not provide instructions that facilitate violence, self-harm, criminal activity, or dangerous weapon/drug misuse.", "لا تقدّم تعليمات تسهّل العنف أو إيذاء النفس أو النشاط الإجرامي أو إساءة استخدام الأسلحة/المواد الخطرة."),
    ("privacy_and_security", "safety", "Protect privacy and security: refuse help with credential theft, doxxing, malware, or unauthorized access.", "احمِ الخصوصية والأمن: ارفض المساعدة في سرقة الحسابات أو التشهير بالمعلومات الشخصية أو البرمجيات الخبيثة أو الوصول غير المصرّح به."),
    ("safe_alternatives", "helpfulness", "When refusing harmful requests, explain briefly and offer safe, constructive alternatives.", "عند رفض الطلبات الضارة، اشرح السبب بإيجاز وقدّم بدائل آمنة وبنّاءة."),
)
# Markers of explanations and doubts, refusals, findings and candidates.
EXPLAINS = ("because", "for example", "خطوات", "مثال")
UNSURE = ("i'm not sure", "i don't know", "غير متأكد")
REFUSAL = "I can’t help with harmful or illegal instructions. I can help with safe alternatives, prevention, or legal learning resources.\nلا أستطيع المساعدة في التعليمات الضارة أو غير القانونية، لكن يمكنني تقديم بدائل آمنة وموارد تعليمية قانونية."
CANDIDATE = "I can provide general educational context, but I will avoid harmful instructions."
HARMFUL_RESPONSE = "Response appears to contain harmful/operational details and should be rewritten."
MISSING_REFUSAL = "Prompt is harmful but response is missing a direct refusal with safe alternatives."
NO_VIOLATION = "No direct violation detected; improve clarity, honesty, and constructive guidance."
EMPTY_ANSWER = "I can help with a clear and safe answer."
OFFER = "\n\nIf you'd like, I can provide a safer step-by-step answer with examples.\nإذا رغبت، يمكنني تقديم إجابة أكثر أمانًا خطوة بخطوة مع أمثلة."
SAFE_PREFIX = "I can’t assist with harmful or illegal details. Here is a safe alternative:\n"
REJECTED = ("Sure, here are direct instructions and exact steps.", "Here is a vague and incomplete answer.")
CHOSEN = ("I can’t help with harmful instructions, but I can give safe alternatives and prevention guidance.", "Here is a complete and practical answer that stays safe and clear.")


def principles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRINCIPLES, "principle_id string, category string, english string, arabic string")


def bilingual(english: Column, arabic: Column) -> Column:
    return F.concat_ws(" / ", english, arabic)


def subset(rows: DataFrame, *categories: str) -> DataFrame:
    """The principles of some categories."""
    return rows.where(F.col("category").isin(*categories))


def lookup(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with their principle; an id that isn't known is an error."""
    found = rows.join(F.broadcast(known.withColumn("_known", F.lit(True))), "principle_id", "left")  # five rows
    name = F.when(F.col("_known"), F.col("principle_id")).otherwise(F.raise_error(F.concat(F.lit("no principle "), F.coalesce("principle_id", F.lit("null")))))
    return found.withColumn("principle_id", name).drop("_known")


def constitutional_examples(prompts: DataFrame) -> DataFrame:
    """``critique_rows`` as instruction data (category E); rows without a prompt or response are dropped."""
    from textmill.operators.convert import turn

    rows = critique_rows(prompts).where(F.length(X.strip(F.col("prompt"))) > 0).where("response <> ''")
    return rows.withColumns({"category": F.lit("E"), "conversation": F.array(turn("user", F.col("prompt")), turn("assistant", F.col("response")))})


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def helpfulness(response: Column) -> Column:
    r = F.coalesce(response, F.lit(""))
    low = F.lower(r)
    points = ((F.length(X.strip(r)) > 0), (F.size(X.plain_words(r)) >= 12), _any(low, EXPLAINS), _any(low, UNSURE))
    out = F.lit(0)
    for p in points:
        out = out + p.cast("int")
    return out


def helpfulness_label(score: Column) -> Column:
    return F.when(score >= 3, "high").when(score == 2, "medium").otherwise("low")


def harmlessness(prompt: Column, response: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(3) - is_harmful(prompt).cast("int") - 2 * is_harmful(response).cast("int"))


def harmlessness_label(score: Column) -> Column:
    return F.when(score >= 2, "safe").when(score == 1, "borderline").otherwise("unsafe")


def critique_findings(prompt: Column, response: Column) -> Column:
    low = F.lower(response)
    found = F.filter(F.array(F.when(is_harmful(response), F.lit(HARMFUL_RESPONSE)), F.when(is_harmful(prompt) & ~low.contains("can’t help") & ~low.contains("cannot help"), F.lit(MISSING_REFUSAL))), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(NO_VIOLATION))).otherwise(found)


def revision(prompt: Column, response: Column, fine: Column) -> Column:
    base = X.falsy_or(X.strip(response), F.lit(EMPTY_ANSWER))
    base = F.when(~F.lower(base).contains("safe") & ~base.contains("آمن"), F.concat(base, F.lit(OFFER))).otherwise(base)
    return F.when(is_harmful(prompt), F.lit(REFUSAL)).when(fine, base).otherwise(F.concat(F.lit(SAFE_PREFIX), base))


def critique_rows(prompts: DataFrame) -> DataFrame:
    """Prompts times principles: (prompt, principle_id, response, critique, language, scores).

    What depends on the prompt alone is worked out once for it, before the five principles,
    which are broadcast, are joined.
    """
    p, cand = F.col("prompt"), F.lit(CANDIDATE)
    found = critique_findings(p, cand)
    rows = prompts.select("prompt", found.alias("_found"), F.when(F.coalesce(p.rlike(X.ARABIC), F.lit(False)), "ar").otherwise("en").alias("language"))
    rows = rows.withColumn("response", revision(p, cand, F.array_contains("_found", NO_VIOLATION)))
    rows = rows.withColumns({"helpful": helpfulness(F.col("response")), "harmless": harmlessness(p, F.col("response")), "_tail": F.concat(F.lit("\n\nPrompt:\n"), p, F.lit("\n\nResponse under review:\n"), cand, F.lit("\n\nCritique:\n- "), F.array_join("_found", "\n- "))})
    rows = rows.repartition("prompt")  # so that the work above isn't done again for each principle
    rows = rows.crossJoin(F.broadcast(principles(prompts.sparkSession)))
    note = F.concat(F.lit("Principle ("), "principle_id", F.lit("):\nEN: "), "english", F.lit("\nAR: "), "arabic", "_tail")
    return rows.select("prompt", "principle_id", "response", note.alias("critique"), "language", "helpful", "harmless")


def preference_rows(prompts: DataFrame) -> DataFrame:
    p = F.col("prompt")
    harmful = is_harmful(p)
    rejected = F.when(harmful, REJECTED[0]).otherwise(REJECTED[1])
    fine = F.array_contains(critique_findings(p, rejected), NO_VIOLATION)
    candidate = F.when(harmful, CHOSEN[0]).otherwise(CHOSEN[1])
    rows = prompts.select("prompt", rejected.alias("rejected"), revision(p, candidate, fine).alias("chosen"), F.when(F.coalesce(p.rlike(X.ARABIC), F.lit(False)), "ar").otherwise("en").alias("language"))
    return rows.withColumns({"chosen_helpful": helpfulness(F.col("chosen")), "chosen_harmless": harmlessness(p, F.col("chosen")), "rejected_harmless": harmlessness(p, F.col("rejected"))})
