"""The registered queries of this subpackage: thin calls over whole tables."""

from __future__ import annotations

from corpuslens.llm import alignment, conversations, images, language_model, lines, mixing, packing, pii, quality, repeats, shingle_join, token_files, urls
from corpuslens.session import ensure_on_workers, table


def _over(name: str, f):
    def query(spark, sf_dir):
        ensure_on_workers(spark)
        return f(table(spark, sf_dir, name))

    return query


def queries() -> dict:
    return {
        "op1_jaccard_join": _over("documents", shingle_join.op1),
        "op2_token_files": _over("documents", token_files.op2),
        "op3_quality_rules": _over("documents", quality.op3),
        "op4_pseudonyms": _over("documents", pii.op4),
        "op5_mixing": _over("documents", mixing.op5),
        "op6_url_filters": _over("pages", urls.op6),
        "op7_language_model": _over("documents", language_model.op7),
        "op8_image_copies": _over("embeddings", images.op8),
        "op9_repeats": _over("documents", repeats.op9),
        "op10_packing": _over("documents", packing.op10),
        "op11_tokenizer_alignment": _over("documents", alignment.op11),
        "op12_line_dedup": _over("documents", lines.op12),
        "op13_conversation_repair": _over("conversations", conversations.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.OP3_SQL, "op5_mixing": mixing.OP5_SQL, "op6_url_filters": urls.OP6_SQL, "op12_line_dedup": lines.OP12_SQL}
