"""Registered queries of this subpackage and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from . import blobledger, lexical, mixing, perspectives, ruleledger, seedextend, winnowing
from .blobledger import blobledger_history, op7_blobledger
from .bpetree import op3_bpetree
from .bwtmerge import op2_bwtmerge
from .importance import op12_importance
from .lexical import op13_lexical
from .mixing import op11_mixing
from .perspectives import op9_perspectives
from .pitmanyor import op4_pitmanyor
from .puquality import op10_puquality
from .ruleledger import op1_ruleledger, ruleledger_ablation
from .seedextend import op5_seedextend
from .simhash import op8_simhash
from .winnowing import op6_winnowing


def queries() -> dict:
    found = [op1_ruleledger, op2_bwtmerge, op3_bpetree, op4_pitmanyor, op5_seedextend, op6_winnowing, op7_blobledger, op8_simhash, op9_perspectives, op10_puquality,
             op11_mixing, op12_importance, op13_lexical, ruleledger_ablation, blobledger_history]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ruleledger": ruleledger.ORACLE_SQL,
        "op5_seedextend": seedextend.ORACLE_SQL,
        "op6_winnowing": winnowing.ORACLE_SQL,
        "op9_perspectives": perspectives.ORACLE_SQL,
        "op11_mixing": mixing.ORACLE_SQL,
        "op13_lexical": lexical.ORACLE_SQL,
        "ruleledger_ablation": ruleledger.ABLATION_SQL,
        "blobledger_history": blobledger.HISTORY_SQL,
    }
