"""seqloom: interval- and sequence-shaped analytics expressed as lazy Spark plans."""
