"""Constants of the engine."""

# Sizes in characters, and retrieval settings.
CHILD_SIZE, CHILD_OVERLAP = 500, 100
MIN_PARENT, MAX_PARENT = 2000, 10000
SCORE_THRESHOLD = 0.7
FUSION_K = 2
TOP_K = 7
BM25_K1, BM25_B, BM25_AVG_LENGTH = 1.2, 0.75, 256.0
EMBED_BUCKETS = 256

# The stages of the pipeline breakdown, in order.
STAGES = ("document_ingestion", "document_chunking", "vector_insertion", "vector_retrieval", "parent_store_operations", "agent_graph_execution", "llm_generation", "evaluation_pipeline", "end_to_end_query")

# Thresholds in seconds.
SLOW_AVERAGE, SLOWEST_AVERAGE, SLOW_P95 = 1.0, 5.0, 2.0

# Messages.
NO_CHUNKS = "NO_RELEVANT_CHUNKS"
NO_PARENTS = "NO_PARENT_DOCUMENTS"
RETRIEVAL_ERROR = "RETRIEVAL_ERROR: "
PARENT_ERROR = "PARENT_RETRIEVAL_ERROR: "
NO_ANSWER = "Unable to generate an answer."
NO_ANSWERS = "No answers were generated."
NEED_DETAIL = "I need more information to understand your question."
