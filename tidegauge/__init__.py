"""Signal analytics on Spark: decode, bin, smooth, normalise, scale and display many sampled signals at once."""
