"""skyloom: calendrical cycles, symbolic charts and text lookup as Spark plans."""
