"""cellarflow.sources"""
