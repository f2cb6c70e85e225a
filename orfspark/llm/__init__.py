"""Training-data operators: quality, URL filters, decontamination, dedup, licences, toxicity, chat, packing."""
