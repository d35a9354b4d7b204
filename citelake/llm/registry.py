"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from citelake.llm import bpe, chat, fingerprints, html_text, itq, mixing, oracles, partenum, pii, quality, secrets

QUERIES = {
    "op1_chat": chat.query,
    "op2_itq": itq.query,
    "op3_secrets": secrets.query,
    "op4_pii": pii.query,
    "op5_partenum": partenum.query,
    "op6_html": html_text.query,
    "op7_mixing": mixing.query,
    "op8_quality": quality.query,
    "op9_fingerprints": fingerprints.query,
    "op10_bpe": bpe.query,
}
ORACLES: dict[str, str] = {"op2_itq": oracles.ITQ, "op3_secrets": oracles.SECRETS, "op4_pii": oracles.PII, "op5_partenum": oracles.PARTENUM, "op6_html": oracles.HTML}
