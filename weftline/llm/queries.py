"""The queries of this subpackage, by name, and the SQL that some of them equal."""

from . import chat_rotation, divergence, line_dedup, url_templates
from .change_applier import op13_change_applier
from .chat_rotation import op1_chat_rotation
from .decontaminate import op9_decontamination
from .divergence import op11_source_divergence
from .line_dedup import op12_line_dedup
from .lm_scoring import op6_lattice_scores
from .mil_classifier import op3_quality_classifier
from .pieces import op2_sentencepiece
from .quality_rules import op7_quality_rules
from .simhash import op4_simhash
from .token_rollups import op8_token_rollups
from .url_templates import op10_url_templates
from .warc import op5_warc

QUERIES = {
    "op1_chat_rotation": op1_chat_rotation,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_lattice_scores": op6_lattice_scores,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_rollups": op8_token_rollups,
    "op9_decontamination": op9_decontamination,
    "op10_url_templates": op10_url_templates,
    "op11_source_divergence": op11_source_divergence,
    "op12_line_dedup": op12_line_dedup,
    "op13_change_applier": op13_change_applier,
}

ORACLE_SQL = {"op1_chat_rotation": chat_rotation.ORACLE, "op10_url_templates": url_templates.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
