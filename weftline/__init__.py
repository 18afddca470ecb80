"""weftline: sparse linear algebra, benchmark analytics and corpus tools as Spark plans."""
