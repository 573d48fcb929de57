"""Rules of the task identification: a table that callers may replace by their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Task, field and pattern of each rule, in order.
RULES: list[tuple[str, str, str]] = [
    ("classification", "system", r"\bclassif"),
    ("classification", "system", r"\bcategor"),
    ("classification", "system", r"\blabel"),
    ("classification", "system", r"\bassign.*class"),
    ("classification", "system", r"\bsentiment"),
    ("classification", "system", r"\btopic\b"),
    ("classification", "system", r"\btag\b"),
    ("classification", "system", r"\bclasse\b"),
    ("classification", "system", r"\bcategoria\b"),
    ("classification", "system", r"\betichetta\b"),
    ("classification", "system", r"\bclassifica\b"),
    ("classification", "system", r"\bspam\b"),
    ("classification", "system", r"\bham\b"),
    ("classification", "system", r"\blabel.?space\b"),
    ("classification", "system", r"\boutput.*(?:label|the label)\b"),
    ("classification", "user", r"\bclassif"),
    ("classification", "user", r"\bcategor"),
    ("classification", "user", r"\blabel"),
    ("classification", "user", r"\bwhich category\b"),
    ("classification", "user", r"\bsentiment\b"),
    ("classification", "user", r"\bclasse\b"),
    ("classification", "user", r"\bcategoria\b"),
    ("classification", "user", r"\blabel.?space\b"),
    ("classification", "output", r"\blabel\b"),
    ("context_qa", "system", r"\bcontext\b"),
    ("context_qa", "system", r"\bdocument"),
    ("context_qa", "system", r"\bpassage\b"),
    ("context_qa", "system", r"\brag\b"),
    ("context_qa", "system", r"\bbased on.*(?:text|context|document|passage)"),
    ("context_qa", "system", r"\banswer.*(?:question|query).*(?:using|based|from|given)"),
    ("context_qa", "system", r"\bquestion.?answer"),
    ("context_qa", "system", r"\bqa\b"),
    ("context_qa", "system", r"\bcontesto\b"),
    ("context_qa", "system", r"\brispondi.*(?:domand|basandoti)"),
    ("context_qa", "system", r"\bdocumento\b"),
    ("context_qa", "system", r"\bverbatim\b"),
    ("context_qa", "system", r"\bexact\s*span\b"),
    ("context_qa", "system", r"\bunanswerable\b"),
    ("context_qa", "system", r"\bchunks?\b"),
    ("context_qa", "system", r"\bcite\b"),
    ("context_qa", "user", r"\bcontext\s*:"),
    ("context_qa", "user", r"\bdocument\s*:"),
    ("context_qa", "user", r"\bpassage\s*:"),
    ("context_qa", "user", r"\bbased on the (?:above|following|given|provided)"),
    ("context_qa", "user", r"\bgiven the (?:context|document|passage|text)"),
    ("context_qa", "user", r"\bcontesto\s*:"),
    ("context_qa", "user", r"\bdocumento\s*:"),
    ("context_qa", "user", r"\bquestion\s*:"),
    ("context_qa", "user", r"\b\[\d+\]"),
    ("context_qa", "output", r"\btext\b"),
    ("metadata_extraction", "system", r"\bextract"),
    ("metadata_extraction", "system", r"\bjson\b"),
    ("metadata_extraction", "system", r"\bmetadata\b"),
    ("metadata_extraction", "system", r"\bstructur"),
    ("metadata_extraction", "system", r"\bkey[- ]?value"),
    ("metadata_extraction", "system", r"\bfield"),
    ("metadata_extraction", "system", r"\bschema\b"),
    ("metadata_extraction", "system", r"\bentit"),
    ("metadata_extraction", "system", r"\bestrai"),
    ("metadata_extraction", "system", r"\bestrazione\b"),
    ("metadata_extraction", "system", r"\bcampo\b"),
    ("metadata_extraction", "system", r"\bcampi\b"),
    ("metadata_extraction", "system", r"\bformato json\b"),
    ("metadata_extraction", "user", r"\bextract.*(?:from|into|as)\b"),
    ("metadata_extraction", "user", r"\bjson\b"),
    ("metadata_extraction", "user", r"\breturn.*json\b"),
    ("metadata_extraction", "user", r"\bkey\s*:"),
    ("metadata_extraction", "user", r"\bfield"),
    ("metadata_extraction", "user", r"\bestrai\b"),
    ("metadata_extraction", "output", r"\bjson\b"),
    ("code_generation", "system", r"\bcode\b"),
    ("code_generation", "system", r"\bprogram"),
    ("code_generation", "system", r"\bfunction\b"),
    ("code_generation", "system", r"\bimplement"),
    ("code_generation", "system", r"\bunit\s*test"),
    ("code_generation", "system", r"\bpython\b"),
    ("code_generation", "system", r"\bjavascript\b"),
    ("code_generation", "system", r"\balgorithm\b"),
    ("code_generation", "system", r"\bclass\b.*(?:method|inherit)"),
    ("code_generation", "system", r"\bwrite.*(?:code|function|program|script)"),
    ("code_generation", "system", r"\bgenera.*codice\b"),
    ("code_generation", "system", r"\bfunzione\b"),
    ("code_generation", "system", r"\bscript\b"),
    ("code_generation", "system", r"\bcodice\b"),
    ("code_generation", "user", r"\bwrite.*(?:code|function|class|program|script)\b"),
    ("code_generation", "user", r"\bimplement\b"),
    ("code_generation", "user", r"\bdef\s+\w+"),
    ("code_generation", "user", r"\bgenerate.*code\b"),
    ("code_generation", "user", r"\bunit\s*test"),
    ("code_generation", "user", r"\bcodice\b"),
    ("code_generation", "user", r"\bfunzione\b"),
    ("code_generation", "output", r"\bcode\b"),
    ("translation", "system", r"\btranslat"),
    ("translation", "system", r"\btraduc"),
    ("translation", "system", r"\btradurre\b"),
    ("translation", "system", r"\btraduzione\b"),
    ("translation", "system", r"\bfrom\s+\w+\s+to\s+\w+"),
    ("translation", "system", r"\btarget\s*language\b"),
    ("translation", "system", r"\bsource\s*language\b"),
    ("translation", "system", r"\blingua\b"),
    ("translation", "user", r"\btranslat"),
    ("translation", "user", r"\btraduc"),
    ("translation", "user", r"\binto\s+(?:english|italian|french|german|spanish|chinese|japanese)"),
    ("translation", "user", r"\bin\s+(?:inglese|italiano|francese|tedesco|spagnolo)"),
    ("translation", "output", r"\btext\b"),
    ("summarization", "system", r"\bsummar"),
    ("summarization", "system", r"\briassun"),
    ("summarization", "system", r"\bsynopsis\b"),
    ("summarization", "system", r"\bcondense\b"),
    ("summarization", "system", r"\bbrief\b.*(?:version|summary)"),
    ("summarization", "system", r"\bshorten\b"),
    ("summarization", "system", r"\bsintesi\b"),
    ("summarization", "system", r"\briassumi\b"),
    ("summarization", "system", r"\briassunto\b"),
    ("summarization", "system", r"\bconcise\b"),
    ("summarization", "system", r"\bkey\s*points?\b"),
    ("summarization", "system", r"\bhighlight"),
    ("summarization", "system", r"\bretain.*(?:important|key|main)"),
    ("summarization", "system", r"\b(?:2|3|two|three).*sentences?\b"),
    ("summarization", "user", r"\bsummar"),
    ("summarization", "user", r"\briassun"),
    ("summarization", "user", r"\bin\s+(?:brief|short|few words)\b"),
    ("summarization", "user", r"\bcondense\b"),
    ("summarization", "user", r"\btl;?dr\b"),
    ("summarization", "user", r"\bsintesi\b"),
    ("summarization", "user", r"\bmeeting\s*notes?\b"),
    ("summarization", "user", r"\bhighlight\b"),
    ("summarization", "output", r"\btext\b"),
    ("rephrasing", "system", r"\brephras"),
    ("rephrasing", "system", r"\brewrite\b"),
    ("rephrasing", "system", r"\breformulat"),
    ("rephrasing", "system", r"\bparaphras"),
    ("rephrasing", "system", r"\briformula"),
    ("rephrasing", "system", r"\briscriv"),
    ("rephrasing", "system", r"\bstile\b.*(?:cambia|diverso)"),
    ("rephrasing", "system", r"\btone\b"),
    ("rephrasing", "system", r"\btono\b"),
    ("rephrasing", "system", r"\bregister\b"),
    ("rephrasing", "system", r"\bformality\b"),
    ("rephrasing", "system", r"\bverbosity\b"),
    ("rephrasing", "system", r"\bvocabulary\b"),
    ("rephrasing", "system", r"\badjust.*(?:tone|style|formality)\b"),
    ("rephrasing", "user", r"\brephras"),
    ("rephrasing", "user", r"\brewrite\b"),
    ("rephrasing", "user", r"\breformulat"),
    ("rephrasing", "user", r"\bparaphras"),
    ("rephrasing", "user", r"\briformula"),
    ("rephrasing", "user", r"\briscriv"),
    ("rephrasing", "user", r"\boriginal\s*message\b"),
    ("rephrasing", "user", r"\btarget.*(?:register|style)\b"),
    ("rephrasing", "output", r"\btext\b"),
    ("sql_generation", "system", r"\bsql\b"),
    ("sql_generation", "system", r"\bquery\b"),
    ("sql_generation", "system", r"\bselect\b"),
    ("sql_generation", "system", r"\bdatabase\b"),
    ("sql_generation", "system", r"\btable\b"),
    ("sql_generation", "system", r"\bschema\b.*(?:table|column|sql)"),
    ("sql_generation", "system", r"\bgenera.*query\b"),
    ("sql_generation", "user", r"\bsql\b"),
    ("sql_generation", "user", r"\bquery\b"),
    ("sql_generation", "user", r"\bselect\b.*\bfrom\b"),
    ("sql_generation", "user", r"\btable\b"),
    ("sql_generation", "user", r"\bwhere\b.*\band\b"),
    ("sql_generation", "output", r"\bsql\b"),
    ("pii_redaction", "system", r"\bpii\b"),
    ("pii_redaction", "system", r"\bredact"),
    ("pii_redaction", "system", r"\bpersonal.*(?:data|info)"),
    ("pii_redaction", "system", r"\banonymiz"),
    ("pii_redaction", "system", r"\bsensitive\b.*(?:data|info)"),
    ("pii_redaction", "system", r"\bprivacy\b"),
    ("pii_redaction", "system", r"\bmask\b"),
    ("pii_redaction", "system", r"\bemail\b.*(?:phone|name)"),
    ("pii_redaction", "system", r"\bdati\s*personal"),
    ("pii_redaction", "system", r"\boscura"),
    ("pii_redaction", "system", r"\banonimizz"),
    ("pii_redaction", "system", r"\bredacted"),
    ("pii_redaction", "system", r"\b\[redacted"),
    ("pii_redaction", "system", r"\bidentif.*information\b"),
    ("pii_redaction", "system", r"\bname.*email.*phone\b"),
    ("pii_redaction", "user", r"\bredact"),
    ("pii_redaction", "user", r"\bremove.*(?:pii|personal|sensitive)\b"),
    ("pii_redaction", "user", r"\bmask\b"),
    ("pii_redaction", "user", r"\banonymiz"),
    ("pii_redaction", "user", r"\boscura\b"),
    ("pii_redaction", "output", r"\btext\b"),
    ("pii_redaction", "output", r"\bredact"),
    ("intent_detection", "system", r"\bintent\b"),
    ("intent_detection", "system", r"\bintention\b"),
    ("intent_detection", "system", r"\buser.*intent\b"),
    ("intent_detection", "system", r"\bdetect.*intent\b"),
    ("intent_detection", "system", r"\bclassif.*intent\b"),
    ("intent_detection", "system", r"\bintento\b"),
    ("intent_detection", "system", r"\bscopo\b"),
    ("intent_detection", "system", r"\bprimary.*intent\b"),
    ("intent_detection", "system", r"\bmultiple\s*intents?\b"),
    ("intent_detection", "system", r"\bmessaggio\s*utente\b"),
    ("intent_detection", "user", r"\bintent\b"),
    ("intent_detection", "user", r"\bwhat.*user.*want\b"),
    ("intent_detection", "user", r"\bintento\b"),
    ("intent_detection", "user", r"\bmessaggio\s*utente\b"),
    ("intent_detection", "output", r"\blabel\b"),
]


def task_rules(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """-> task, field, pattern."""
    return spark.createDataFrame(RULES if rules is None else rules, "task string, field string, pattern string")
