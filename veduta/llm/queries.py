"""Queries of this subpackage and their SQL, added to the entry module when the subpackage is present."""

from __future__ import annotations

from . import decontamination, embeddings, html, jaccard, licenses, mixing, pii, quality, secrets, warc

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_decontamination": decontamination.op5_decontamination,
    "op5_near_decontamination": decontamination.op5_near_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_html": html.op7_html,
    "op8_licenses": licenses.op8_licenses,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_secrets": secrets.op10_secrets,
}
SQL = {
    "op1_embeddings": embeddings.SQL,
    "op3_mixing": mixing.SQL,
    "op5_decontamination": decontamination.SQL,
    "op6_warc": warc.SQL,
    "op8_licenses": licenses.SQL,
    "op9_jaccard": jaccard.SQL,
}
