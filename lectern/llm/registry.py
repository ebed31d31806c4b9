"""The queries of this subpackage and their SQL."""

from lectern.llm import licenses, topk, trie
from lectern.llm.bpe import op8_byte_bpe
from lectern.llm.jaccard import op9_near_duplicates
from lectern.llm.langid import op7_language
from lectern.llm.minhash import op11_minhash
from lectern.llm.packing import op1_packing
from lectern.llm.quality import op4_quality
from lectern.llm.runs import op12_runs
from lectern.llm.substrings import op3_substrings
from lectern.llm.text import small_batches
from lectern.llm.tokenfile import op10_token_files
from lectern.llm.urls import op2_urls

QUERIES = {
    "op1_packing": op1_packing,
    "op2_urls": op2_urls,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_topk": topk.op5_topk,
    "op6_licenses": licenses.op6_licenses,
    "op7_language": op7_language,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_files": op10_token_files,
    "op11_minhash": op11_minhash,
    "op12_runs": op12_runs,
    "op13_trie": trie.op13_trie,
}
QUERIES = {name: small_batches(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": topk.ORACLE,
    "op6_licenses": licenses.oracle(),
    "op13_trie": trie.ORACLE,
}
