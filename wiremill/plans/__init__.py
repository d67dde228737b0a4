"""wiremill.plans"""
