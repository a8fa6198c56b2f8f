"""Link analytics on Spark: build, score and compare regulator-site-target link tables."""
