"""cellarflow.functions"""
