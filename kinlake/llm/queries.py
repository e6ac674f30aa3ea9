"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from kinlake.llm import arc_warc, arrow_stream, hilbert, license_scan, packing, pfair, quality_rules, simhash, site_bayes, spotsigs

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_hilbert": hilbert.op3_hilbert,
    "op4_pfair": pfair.op4_pfair,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_arrow_stream": arrow_stream.op8_arrow_stream,
    "op9_arc_to_warc": arc_warc.op9_arc_to_warc,
    "op10_site_bayes": site_bayes.op10_site_bayes,
}

ORACLES = {
    "op1_license_scan": license_scan.oracle(),
}
