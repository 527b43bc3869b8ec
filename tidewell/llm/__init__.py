"""Training-data operators (see README, section "llm")."""
