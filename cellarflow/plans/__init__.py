"""cellarflow.plans"""
