"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import licences, mixing
from .bpe import op3_bpe_trie
from .frames import op1_token_frames
from .language import op7_language_id
from .licences import op6_licence_scan
from .likelihood import op10_likelihood_ratio
from .merkle import op2_merkle
from .mixing import op8_poisson_mix
from .rules import op9_rule_ensemble
from .simhash import op5_simhash
from .urls import op4_url_filter

_ALL = (op1_token_frames, op2_merkle, op3_bpe_trie, op4_url_filter, op5_simhash, op6_licence_scan, op7_language_id, op8_poisson_mix, op9_rule_ensemble, op10_likelihood_ratio)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op6_licence_scan": licences.oracle_sql(), "op8_poisson_mix": mixing.ORACLE_SQL}
